"""Secret scans with an incremental blob ledger.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger holds what is
known about a (blob, rule version) pair; only pairs that it doesn't hold are scanned, each blob once
however many paths or versions carry it, and the findings are joined back to all of them. The
ledger is an ordinary table: write what ``scan`` adds beside the old rows and pass it on the next run.

Defined cases: a null text is the empty text; repeated rows come out as often as they go in; a
blob without findings has an empty list in the ledger, so that it isn't scanned again; an empty
table gives an empty result and adds nothing to the ledger.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import bounded_batches, read_table, written

#: Bump with every change of the rules, so that blobs are scanned again.
RULE_VERSION = 1
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version int, spans {SPANS}"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _scan_batches(batches):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), x)) for x in find_secrets(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, spans)], ["blob", "spans"])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def suspicious(text: Column) -> Column:
    """True for every text with a finding and for few others: what is false needs no scan and no shuffle of its text."""
    text = F.coalesce(text, F.lit(""))
    told = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""")
    return told | (F.contains(text, F.lit("AKIA")) & text.rlike("AKIA[A-Z0-9]{14}")) | text.rlike("[0-9a-f]{16}")


def scan(versions: DataFrame, ledger: DataFrame | None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``versions`` (column text) that ``ledger`` doesn't hold under ``rule_version``.

    Copies of a blob are put together before the shuffle, and one of them is scanned. Only suspicious texts travel;
    the others go into the ledger as clean by their address alone.
    """
    bounded_batches(versions.sparkSession)
    text = F.when(suspicious(F.col("text")), F.col("text"))
    unseen = versions.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    found = unseen.mapInArrow(_scan_batches, f"blob string, spans {SPANS}")
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", rule_version: int = RULE_VERSION) -> DataFrame:
    """``path``, blob and spans of every row of ``versions``, from a ledger that holds all its blobs.

    Rows without a suspicious text have no findings and take no part in the join, so neither an empty text nor any
    other clean one that most paths share is a hot key.
    """
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    rows = versions.select(F.col(path), blob_of(F.col("text")).alias("blob"), suspicious(F.col("text")).alias("suspicious"))
    none = F.array().cast(SPANS)
    joined = rows.where("suspicious").join(hits, "blob", "left").select(path, "blob", F.coalesce("spans", none).alias("spans"))
    return joined.unionByName(rows.where("not suspicious").select(path, "blob", none.alias("spans")))


def before_last_line(text: Column) -> Column:
    """A text as it stood before its last line was written; one of a single line is unchanged."""
    return F.when(F.contains(text, F.lit("\n")), F.left(text, F.char_length(text) - F.char_length(F.substring_index(text, "\n", -1)) - 1)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document pass the ledger: each text before its last line was written, then the text itself.

    The second run scans only blobs that the first has not seen. The result is that of the second version.
    """
    docs = read_table(spark, sf_dir, "documents")
    first = written(scan(docs.select(before_last_line(F.col("text")).alias("text")), None))
    ledger = first.unionByName(written(scan(docs, first)))
    found = findings(docs, ledger)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))
