"""One-permutation MinHash with optimal densification and b-bit packing.

The 64-bit hashes of a text's five-word shingles are dealt once into ``BINS`` bins and each bin
keeps its least value. An empty bin copies the first non-empty bin on a walk that is fixed per
bin (a permutation of all bins, the same for every text), which is the optimal densification.
Of each bin ``BITS`` low-order bits, mixed
with the bin's number, are stored. Two values agree by chance with probability
c = 2^-BITS, so the likeness is (agreement - c) / (1 - c), clipped to 0..1.

Defined cases: a null text counts as empty; a text without words has the empty string as its
fingerprint, is like another empty one with 1 and like any other text with 0; a text of fewer than
five words is one shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm.common import bounded_batches, chunks_by_bytes, mix64, read_table, shingle_hashes

BINS, BITS, WIDTH = 512, 2, 5
_EMPTY = np.iinfo(np.uint64).max
_WALKS: list = []


def _walks() -> np.ndarray:
    if not _WALKS:
        rng = np.random.default_rng(7)
        _WALKS.append(np.stack([rng.permutation(BINS) for _ in range(BINS)], 1))
    return _WALKS[0]


def signatures(texts: list, shingles: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the densified bins (texts x BINS), and which texts have words; ``shingles`` are those of the texts if known."""
    row, h = shingles or shingle_hashes(texts, WIDTH)
    n = len(texts)
    table = np.full(n * BINS, _EMPTY, np.uint64)
    np.minimum.at(table, row * BINS + (h >> np.uint64(55)).astype(np.int64), h & np.uint64((1 << 55) - 1))
    table = table.reshape(n, BINS)
    filled = table != _EMPTY
    any_word = filled.any(1)
    walks, dense = _walks(), table.copy()
    r, b = np.nonzero(~filled & any_word[:, None])
    for step in range(24):
        if not len(r):
            break
        donor = walks[step, b]
        good = filled[r, donor]
        dense[r[good], b[good]] = table[r[good], donor[good]]
        r, b = r[~good], b[~good]
    for one in np.unique(r):  # few bins are filled: look along the whole walks
        bins = b[r == one]
        donor = walks[filled[one][walks[:, bins]].argmax(0), bins]
        dense[one, bins] = table[one, donor]
    # bits drawn anew per bin: a value copied into many bins then agrees by chance in each on its own
    salted = mix64(dense + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (salted & np.uint64((1 << BITS) - 1)).astype(np.uint8), any_word


def packed(low: np.ndarray, any_word: np.ndarray) -> list[str]:
    planes = np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=BITS)
    data = np.packbits(planes.reshape(len(low), -1), axis=1, bitorder="little")
    return [d.tobytes().hex() if w else "" for d, w in zip(data, any_word)]


def likeness(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, b_words: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_words & b_words, found, np.where(a_words == b_words, 1.0, 0.0))


def packed_likeness(a: bytes, b: bytes) -> float:
    """Likeness of two packed fingerprints (empty: a text without words)."""
    if not a or not b:
        return float(a == b)
    apart = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
    mask = int("01" * BINS, 2)  # one bit of each two-bit field
    agree = 1 - ((apart | apart >> 1) & mask).bit_count() / BINS
    return max(0.0, (agree - 2.0**-BITS) / (1 - 2.0**-BITS))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = []
            for lo, hi in chunks_by_bytes(texts):
                found += packed(*signatures(texts[lo:hi]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (block, role, doc_id, text) sorted so that each document follows the next one.

    Blocks are ranges of doc_id. The first document of a block is also sent to the block before
    it (role 1), so that every block holds all it needs. Ids are dealt by quantiles; the driver
    sees one bound and one id per block, as many as ``spark.sql.shuffle.partitions`` asks for.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 2 * parts
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right"), dtype="int32")

    ids = rows.select("doc_id").where("doc_id is not null")
    heads = sorted((r["block"], r["head"]) for r in ids.groupBy(block_of("doc_id").alias("block")).agg(F.min("doc_id").alias("head")).collect())
    before = {head: last for (_, head), (last, _) in zip(heads, heads[-1:] + heads[:-1])}

    @F.pandas_udf("int")
    def copy_to(ids: pd.Series) -> pd.Series:
        return ids.map(before).astype("Int32")

    nameless = -1 - F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")
    known = F.coalesce("doc_id", F.lit(0))
    block = F.when(F.col("doc_id").isNotNull(), block_of(known)).otherwise(nameless)
    target = F.when(F.col("doc_id").isNotNull(), copy_to(known))
    own = F.struct(F.col("block"), F.lit(0).alias("role"))
    copy = F.struct(F.col("target").alias("block"), F.lit(1).alias("role"))
    dealt = rows.select("doc_id", "text", block.alias("block"), target.alias("target")).select("doc_id", "text", F.explode(F.when(F.col("target").isNotNull(), F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    return (
        dealt.select("at.block", "at.role", "doc_id", "text")
        .repartition(parts, "block")
        .sortWithinPartitions("block", F.desc("role"), F.desc("doc_id"), "text")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and the likeness to the edit and to the next document.

    The edited text has the last floor(n / 4) code points replaced by the first as many of the
    next document: the next greater doc_id, after the last the first. Of repeated rows of the
    next doc_id the least text counts. A row with a null doc_id has an empty next document.
    """

    def work(batches):
        block, latest, nxt = None, None, None  # latest and nxt: (doc_id, text, low bits, has words)
        nothing = (None, "", np.zeros(BINS, np.uint8), np.False_)
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("block", "role", "doc_id", "text")]
            for lo, hi in chunks_by_bytes(cols[3]):
                texts = cols[3][lo:hi]
                low, words = signatures(texts)
                own, after, edits = [], [], []
                for i, (b, role, doc_id) in enumerate(zip(*(c[lo:hi] for c in cols[:3]))):
                    if b != block:
                        block, latest, nxt = b, None, None
                    if doc_id is None:
                        nxt = nothing
                    elif role:
                        latest = latest or ((None, True), texts[i], low[i].copy(), words[i])
                        continue
                    elif latest is None or latest[0] != doc_id:
                        latest, nxt = (doc_id, texts[i], low[i].copy(), words[i]), latest
                    cut = len(texts[i]) // 4
                    own.append(i)
                    after.append(nxt)
                    edits.append(texts[i][: len(texts[i]) - cut] + nxt[1][:cut])
                if not own:
                    continue
                low, words = low[own], words[own]
                edit_low, edit_words = np.zeros_like(low), np.zeros_like(words)
                for a, z in chunks_by_bytes(edits):
                    edit_low[a:z], edit_words[a:z] = signatures(edits[a:z])
                next_low, next_words = np.stack([x[2] for x in after]), np.array([x[3] for x in after])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cols[2][lo + i] for i in own], pa.int64()),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                        pa.array(packed(low, words), pa.string()),
                        pa.array(packed(edit_low, edit_words), pa.string()),
                        pa.array(likeness(low, words, edit_low, edit_words)),
                        pa.array(likeness(low, words, next_low, next_words)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(read_table(spark, sf_dir, "documents"))
