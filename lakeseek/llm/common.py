"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MAX_CHUNK_BYTES = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the session.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Only where the
    setting is absent (unit tests) a folder of our own is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch between Spark and Python; a longer row stands alone.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python in batches of at most BATCH_BYTES.

    By default a batch has 10,000 rows however long their texts are, in two processes at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, about half as large as a checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))  # sets the folder where the session has none
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_by_bytes(texts: list, limit: int = MAX_CHUNK_BYTES):
    """(lo, hi) row ranges whose texts take about ``limit`` bytes; a longer text stands alone."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n + 1
    if lo < len(texts):
        yield lo, len(texts)


# ---- word hashing on flat byte buffers -------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words (runs without ASCII white space) of a byte buffer.

    Works slice by slice, cut at white space, so temporaries stay near the slice size
    however long the buffer is.
    """
    starts, ends, hashes = [], [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + MAX_CHUNK_BYTES)
        while to < n:
            back = np.flatnonzero(_SEP[buf[max(at, to - 4096) : to]])
            if len(back):
                to = max(at, to - 4096) + int(back[-1]) + 1
                break
            to = min(n, to + 4096)
        part = buf[at:to]
        word = ~_SEP[part]
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p, inv = _powers(len(part) + 1)
        codes = _VALUES[_LOWER[part] if lower else part]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes * p[: len(part)], out=total[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix64((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, each followed by a blank, and the offset of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8), offsets


def shingle_hashes(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each word shingle of the texts, A-Z lower-cased.

    A text of fewer words than ``width`` has one shingle of all its words; a text
    without words has none.
    """
    buf, offsets = joined(texts)
    starts, _, words = word_hashes(buf)
    row = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[row]
    full = place + width <= np.maximum(count, width)[row]
    full &= (count[row] >= width) | (place == 0)
    at = np.flatnonzero(full)
    mixed = np.zeros(len(at), np.uint64)
    for j in range(width):
        k = np.minimum(at + j, len(words) - 1)
        inside = (at + j < len(words)) & (row[k] == row[at])
        mixed += np.where(inside, words[k] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 3)) & (1 << 64) - 1 | 1), np.uint64(0))
    return row[at], mix64(mixed)
