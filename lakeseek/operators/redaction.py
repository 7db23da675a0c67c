"""Personal-data spans, redaction, tagging and the audit log of ingestion."""

from __future__ import annotations

import json
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns decide what counts as a finding.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?<!\d)(?:\+1[\s\-]?)?(?:\(\d{3}\)[\s\-]?|\d{3}[\s\-])\d{3}[\s\-]\d{4}(?!\d)",
    "SSN": r"(?<!\d)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)",
    "CREDIT_CARD": r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}(?!\d)",
}
MASK_ERROR = "[PII_REDACTION_ERROR]"
SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


#: Texts of these characters alone mean the same to Java's and Python's patterns.
PLAIN = r"^[\x00-\x1b\x20-\x7f]*$"


def counted(text: Column, kind: str) -> Column:
    """Findings of a kind: counted in the JVM where the text is plain ASCII, by the detector elsewhere."""
    plain = F.coalesce(text, F.lit("")).rlike(PLAIN)
    return F.when(plain, F.coalesce(F.regexp_count(text, F.lit(PATTERNS[kind])), F.lit(0))).otherwise(F.size(F.filter(spans(F.when(~plain, text)), lambda s: s["type"] == kind)))


@cache
def _compiled() -> dict[str, re.Pattern]:
    return {k: re.compile(p, re.IGNORECASE if k == "EMAIL" else 0) for k, p in PATTERNS.items()}


def found_in(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p in _compiled().items() for m in p.finditer(text or "")]


def clean_text(text: str | None) -> str | None:
    """A text with each finding, overlaps as one, replaced by its type in brackets; what can't be read is withheld."""
    if text is None:
        return None
    try:
        out, at = [], 0
        for start, upto, kind in sorted((s, -e, k) for k, s, e in found_in(text)):
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, -upto)
        return "".join(out) + text[at:]
    except Exception:  # noqa: BLE001 - a trace must not carry what couldn't be checked
        return MASK_ERROR


@F.pandas_udf(T.StringType())
def cleaned(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def cleaned_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [clean_text(x) for x in xs])


@F.pandas_udf(T.StringType())
def cleaned_json(docs: pd.Series) -> pd.Series:
    """JSON with every string value cleaned, at any depth; keys stay."""

    def walk(x):
        if isinstance(x, str):
            return clean_text(x)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return docs.map(lambda d: None if d is None else json.dumps(walk(json.loads(d))))


@F.pandas_udf(SPANS)
def spans(texts: pd.Series) -> pd.Series:
    """Findings in pattern order, then match order; they may overlap across types."""
    return texts.map(lambda t: [{"type": k, "start": s, "end": e} for k, s, e in found_in(t)])


def merged(found: Column) -> Column:
    """Spans by start, longer first; an overlap extends the one before and keeps its type. Touching spans stay apart."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("upto"), s["type"].alias("type"))))
    spans_of = F.transform(ordered, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), (-s["upto"]).alias("end")))

    def fold(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["type"].alias("type"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        inside = (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"])
        return F.when(inside, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans_of, F.array().cast(SPANS), fold)


def redacted(text: Column, found: Column) -> Column:
    """Each merged span replaced by its type in brackets."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        merged(found), state,
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["type"], F.lit("]")).alias("out")),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)),
    )


def types_of(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: s["type"])))


def ingested(docs: DataFrame, mode: str = "redact") -> DataFrame:
    """Documents with pii_spans; in redact mode their texts are cleaned, in keep mode pii_types names what they hold."""
    return treated(docs.withColumn("pii_spans", spans(F.col("text"))), mode)


def treated(found: DataFrame, mode: str = "redact") -> DataFrame:
    """``ingested`` of documents whose pii_spans are known."""
    if mode == "redact":
        return found.withColumn("text", redacted(F.col("text"), F.col("pii_spans")))
    if mode == "keep":
        return found.withColumn("pii_types", types_of(F.col("pii_spans")))
    raise ValueError(f"unknown mode: {mode}")


def audit(rows: DataFrame, at: Column, salt: str | None = None, hash_values: bool = False) -> DataFrame:
    """One value-free row per finding of rows (tenant_id, doc_id, chunk_id, text, pii_spans), with a salted hash on request."""
    if hash_values and not salt:
        raise ValueError("hashing values needs a salt")
    each = rows.select("tenant_id", "doc_id", "chunk_id", "text", F.explode("pii_spans").alias("s"))
    value = F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    hashed = F.substring(F.sha2(F.concat(F.lit(salt or ""), value), 256), 1, 16) if hash_values else F.lit(None).cast("string")
    return each.select("tenant_id", "doc_id", "chunk_id", F.col("s.type").alias("type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), at.alias("timestamp"), hashed.alias("value_hash"))
