"""Folders of uploaded files to documents: plain text, Markdown, HTML and DOCX, with a reason for every file that gives none.

``folder`` lists through Spark's own file source, so any storage that Spark reads will do and files are dealt over the tasks by size.
Files over the limit are told by their length alone: the filter on ``length`` reaches the scan and their bytes are never read.
Files of no bytes at all have no row, neither as documents nor as rejects: Spark's source doesn't give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.sources import corpora, docx, html

# File name endings and their types.
ENDINGS = {"txt": "text/plain", "text": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "docx": docx.CONTENT_TYPE, "pdf": "application/pdf"}
UNKNOWN = "application/octet-stream"
#: Bytes that one Arrow batch of files may hold on its way to Python.
BATCH_BYTES = 32 * 1024 * 1024


def type_of(path: Column) -> Column:
    """The content type that a name's ending stands for."""
    pairs = [F.lit(x) for pair in ENDINGS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(UNKNOWN))


def parsed(files: DataFrame) -> DataFrame:
    """Files (content_type, content and more) with ``text``, or ``error`` (name of the fault) and ``detail``.

    A file without content is a KeyError, a type outside the list or too many bytes an UnsupportedTypeError, one without text a ParserError.
    """
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    told = corpora.plain_text(corpora.accepted(files))
    is_kind = lambda kind: (F.col("content_type") == kind) & F.col("reason").isNull()
    shown = html.html_to_text(F.when(is_kind("text/html"), F.col("text")))
    word = docx.docx_to_text(F.when(is_kind(docx.CONTENT_TYPE), F.col("content")))
    out = told.withColumn("_word", word).withColumn("text", F.when(F.col("content_type") == "text/html", shown).when(F.col("content_type") == docx.CONTENT_TYPE, F.col("_word.text")).otherwise(F.col("text")))
    empty = F.col("text").isNull() | (F.trim("text") == "")
    error = F.when(F.col("content").isNull(), "KeyError").when(F.col("reason").isNotNull(), "UnsupportedTypeError").when(empty, "ParserError")
    detail = F.when(error.isNotNull(), F.coalesce("reason", "_word.fault", F.when(F.col("content").isNull(), "no content").otherwise("no text")))
    return out.withColumn("error", error).withColumn("detail", detail).withColumn("text", F.when(error.isNull(), F.col("text"))).drop("reason", "_word")


def folder(spark: SparkSession, path: str, max_bytes: int = corpora.MAX_BYTES) -> DataFrame:
    """path, content_type, size_bytes, text, error, detail of every file below ``path``: ``error`` is null for the documents, the rest are the rejects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.select("path", type_of(F.col("path")).alias("content_type"), F.col("length").alias("size_bytes"), "content")
    wanted = F.col("content_type").isin(*corpora.TEXT_TYPES)
    read = parsed(known.where((F.col("size_bytes") <= max_bytes) & wanted))
    columns = ["path", "content_type", "size_bytes", "text", "error", "detail"]
    left = known.where((F.col("size_bytes") > max_bytes) | ~wanted).select(
        "path", "content_type", "size_bytes", F.lit(None).cast("string").alias("text"), F.lit("UnsupportedTypeError").alias("error"), F.when(~wanted, "unsupported type").otherwise("too large").alias("detail"),
    )
    return read.select(*columns).unionByName(left)
