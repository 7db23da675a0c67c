"""Corpus adapters: rows of a corpus to documents and golden questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeseek.functions.ranks import numbered
from lakeseek.sources import docx

MAX_BYTES = 25 * 1024 * 1024
TEXT_TYPES = ("text/plain", "text/markdown", "text/html", docx.CONTENT_TYPE)


def titled_paragraphs(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows (row_no, context: array<struct<title, sentences>>) to one document per title, the first one wins."""
    rows = rows.where(F.col("row_no") < limit) if limit is not None else rows
    flat = rows.select("row_no", F.posexplode("context").alias("place", "c"))
    order = Window.partitionBy("title").orderBy("row_no", "place")
    return (
        flat.select("row_no", "place", F.col("c.title").alias("title"), F.array_join("c.sentences", " ").alias("text"))
        .withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("title").alias("doc_id"), "title", "text")
    )


def supporting_titles(facts: str = "supporting_facts.title"):
    return F.array_distinct(facts)


def titled_golden(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_no").cast("string").alias("id"), "question", F.col("answer").alias("expected_output"), supporting_titles().alias("relevant_doc_ids"), F.lit("public").alias("tenant_id"))


def papers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines with id, title and abstract (or text); blank lines are skipped, ``limit`` counts raw lines, blank ones too.

    A line without an id is named by its number.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    lines = numbered(raw, [], ["file_path", "file_block_start", "place"], "line").where("trim(value) <> ''")
    lines = lines.where(F.col("line") <= limit) if limit is not None else lines
    row = lines.select("line", F.from_json("value", "id string, title string, abstract string, text string").alias("r"))
    return row.select(F.coalesce("r.id", F.format_string("arxiv::%06d", F.col("line") - 1)).alias("doc_id"), "r.title", F.coalesce("r.abstract", "r.text", F.lit("")).alias("text"))


def generated_golden(docs: DataFrame, generate=None) -> DataFrame:
    """Questions by a generator column function that gives JSON; rows that don't parse are skipped. Without a generator there is no golden set."""
    if generate is None:
        raise ValueError("a golden set of papers needs a generator")
    parsed = docs.withColumn("g", F.from_json(generate(F.col("text")), "question string, answer string"))
    return parsed.where("g.question is not null and g.answer is not null").select("doc_id", "g.question", F.col("g.answer").alias("expected_output"))


def filings(rows: DataFrame) -> DataFrame:
    """Rows (row_no, company, evidence: array<string>, question, answer) to documents with their golden row."""
    return rows.select(F.format_string("financebench::%s::%d", "company", "row_no").alias("doc_id"), F.array_join("evidence", "\n\n").alias("text"), "question", "answer")


def filings_golden(docs: DataFrame) -> DataFrame:
    full = docs.where("length(trim(question)) > 0 and length(trim(answer)) > 0")
    return full.select("question", F.col("answer").alias("expected_output"), F.array("doc_id").alias("relevant_doc_ids"))


LOADERS: dict[str, Callable] = {"hotpotqa": titled_paragraphs, "arxiv": papers, "financebench": filings}


def loader(name: str) -> Callable:
    if name not in LOADERS:
        raise ValueError(f"unknown corpus: {name}")
    return LOADERS[name]


def accepted(files: DataFrame) -> DataFrame:
    """binaryFile rows with content_type: ``reason`` is null for those to parse, else why not."""
    return files.withColumn(
        "reason",
        F.when(~F.coalesce(F.col("content_type").isin(*TEXT_TYPES), F.lit(False)), "unsupported type").when(F.octet_length("content") > MAX_BYTES, "too large"),
    )


def plain_text(files: DataFrame) -> DataFrame:
    """UTF-8 with replacement of malformed bytes."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def golden_file(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, question string, ground_truth string, expected_output string, relevant_chunk_ids array<string>, tenant_id string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select("id", "question", F.coalesce("ground_truth", "expected_output").alias("expected_output"), F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")).alias("relevant_chunk_ids"), F.coalesce("tenant_id", F.lit("public")).alias("tenant_id"))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, one record, or {"results": [...]}."""
    record = "latency_ms double, cost_usd double, metrics map<string,double>"
    raw = spark.read.schema(f"{record}, results array<struct<{record.replace(' ', ':', 1).replace(', cost_usd ', ', cost_usd:').replace(', metrics ', ', metrics:')}>>").json(path, multiLine=True)
    return raw.select(F.explode(F.coalesce("results", F.array(F.struct("latency_ms", "cost_usd", "metrics")))).alias("r")).select("r.*")


def gold_tenants(golden: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tenants of documents: the tenant of a golden row that needs the document wins over the split."""
    needed = golden.select(F.explode("relevant_doc_ids").alias("doc_id"), "tenant_id").groupBy("doc_id").agg(F.min("tenant_id").alias("gold_tenant"))
    return assigned.join(needed, "doc_id", "left").select("doc_id", F.coalesce("gold_tenant", "tenant_id").alias("tenant_id"))


#: Words of a text's inside by which it is looked up.
KEY_WORDS = 5


def holding(docs: DataFrame, items: DataFrame, item: str = "query_id", text: str = "question") -> DataFrame:
    """``item`` and doc_id of every document that holds an item's whole text.

    A text's first and last words may be cut out of longer ones, those between stand in the document as they are: five of
    them are a key by which documents and items meet, and whole texts are compared then. Only items of under seven
    words are compared with every document.
    """
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    keyed = items.select(item, F.col(text).alias("_text"), words.alias("_w"))
    enough = F.size("_w") >= KEY_WORDS + 2
    long_ones = keyed.where(enough).select(item, "_text", F.xxhash64(F.slice("_w", 2, KEY_WORDS)).alias("_key"))
    runs = F.expr(f"transform(sequence(1, greatest(size(_w) - {KEY_WORDS - 1}, 1)), i -> xxhash64(slice(_w, i, {KEY_WORDS})))")
    split = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("_w"))
    keys = split.where(F.size("_w") >= KEY_WORDS).select("doc_id", F.explode(F.array_distinct(runs)).alias("_key"))
    met = keys.join(long_ones, "_key").select(item, "doc_id", "_text").distinct().join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    found = met.where(F.contains("_doc", "_text")).select(item, "doc_id")
    short = keyed.where(~enough).select(item, "_text")
    if not short.limit(1).count():
        return found
    return found.unionByName(docs.join(short, F.contains(docs["text"], short["_text"])).select(item, "doc_id"))


def assigned_tenants(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, tenant_id: about 90 % public, 5 % tenant_a, 5 % tenant_b, by a hash of seed and id."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(100))
    return docs.select("doc_id", F.when(draw < 90, "public").when(draw < 95, "tenant_a").otherwise("tenant_b").alias("tenant_id"))
