"""Removal of byte strings of 400 that start anywhere else, over sampled sorted suffixes.

Sampling. Every start s of a 400-byte string looks at the 16-byte grams that begin at s .. s + 319; the
leftmost least gram (by a 32-bit hash) is its anchor. Equal strings have their anchors at equal places, so
repeats can only be found among suffixes that begin at anchors: about one position in 130. An anchor owns the
run of starts that chose it, and the first 81 bytes of its suffix lie in all their strings.

Sorting. Map tasks sort the anchored suffixes, collapse equal ones and front-code them into runs (length
of the prefix shared with the one before, then the rest). Runs are cut at quantiles of a sample of all suffixes
and dealt out by range, so the merged ranges are one global order; a suffix that a third of all documents hold
arrives once per run. Tasks combine the runs of a range with a loser tree whose nodes keep the common prefix
with the last winner: of two heads the one with the longer known prefix wins at once, and only equal ones are
compared, from behind that prefix. A suffix whose prefix in common with its neighbour in the order is all of its
81 bytes is shared; all others are done.

Resolving. The starts of shared anchors are cut into pieces by their distance to the anchor (64 to a
class). The 337 bytes that all strings of a class contain are its key; a piece whose whole content recurs
repeats with all its starts. Pieces that share a key with other content are compared start by
start. Classes meet on 64-bit keys and 128-bit contents, aggregated before every shuffle, so no group of
copies meets in one task.

Exact copies of a text of 400 bytes or more are removed whole; one copy stands for them above.

Cutting. Starts become maximal spans without their texts; then only texts that lose something meet their spans.

Defined cases: a null text is empty; texts under 400 bytes lose nothing; repeated rows are documents of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm.common import _powers, _VALUES, bounded_batches, chunks_by_bytes, mix64, read_table, written

LENGTH, WINDOW, GRAM, CLASS = 400, 320, 16, 64
PREFIX = LENGTH - WINDOW + 1
KEY = LENGTH - CLASS + 1
SLICE = 1 << 17
#: Suffixes of a task's run, and about as many of a range.
RUN_ROWS, RANGE_ROWS = 200_000, 100_000
#: Texts sampled for the ranges: at least SAMPLE_TEXTS, at least one in SAMPLE_SHARE.
SAMPLE_TEXTS, SAMPLE_SHARE = 2000, 200
FILTER_BITS = 1 << 25
_GRAMS = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_OTHER = np.random.default_rng(32).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = -(-PREFIX // 8)
SPANS = "array<struct<lo: long, hi: long>>"


class Hashed:
    """Polynomial prefix sums of bytes: 64-bit hashes of any substrings."""

    def __init__(self, part: np.ndarray, values: np.ndarray = _VALUES):
        p, self.inverse = _powers(len(part) + 1)
        self.total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * p[: len(part)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(part: np.ndarray) -> np.ndarray:
    """32-bit hashes of the 16-byte grams, by doubling."""
    h, step = _GRAMS[part], 1
    for factor in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F):
        h = h[:-step] * np.uint32(factor) + h[step:]
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def window_least(h: np.ndarray) -> np.ndarray:
    """Least of each WINDOW values, by doubling; two overlapping runs cover what is left."""
    step = 1
    while 2 * step <= WINDOW:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (WINDOW - step)], h[WINDOW - step :]) if step < WINDOW else h


def anchors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text, anchor, first start, last start), places counted in the buffer, by start."""
    found = []
    for x in range(0, len(buf), SLICE):
        part = buf[x : x + SLICE + WINDOW + GRAM]
        if len(part) < GRAM + WINDOW - 1:
            break
        h = gram_hashes(part)
        least = window_least(h)[:SLICE]
        # a run of starts ends where the least value changes or its place is passed
        passed = h[: len(least)] == least
        ends = passed.copy()
        ends[:-1] |= least[1:] != least[:-1]
        ends[-1] = True
        last = np.flatnonzero(ends)
        first = np.concatenate([[0], last[:-1] + 1])
        chosen = last.copy()
        ahead = np.flatnonzero(~passed[last])  # their anchor lies behind the run's last start
        windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        for k in range(0, len(ahead), 1024):
            a = first[ahead[k : k + 1024]]
            chosen[ahead[k : k + 1024]] = a + (windows[a] == least[a][:, None]).argmax(1)
        found.append(np.stack([first + x, last + x, chosen + x], 1))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    new = np.flatnonzero(np.concatenate([[True], rows[1:, 2] != rows[:-1, 2]]))  # else a slice's end has cut the run
    first, last, chosen = rows[new, 0], rows[np.append(new[1:], len(rows)) - 1, 1], rows[new, 2]
    # cut at the ends of texts
    low = np.searchsorted(offsets, first, "right") - 1
    n = np.searchsorted(offsets, last, "right") - low
    row = np.repeat(np.arange(len(n)), n)
    text = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    text = np.minimum(text, len(offsets) - 2)
    lo, hi = np.maximum(first[row], offsets[text]), np.minimum(last[row], offsets[text + 1] - LENGTH)
    good = lo <= hi
    return np.stack([text, chosen[row], lo, hi], 1)[good]


def _bytes_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


# ---- sorted, front-coded runs and their merge ------------------------------------------


def suffixes_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The PREFIX bytes from each place as big-endian words (rows x _WORDS), whose order is that of the bytes."""
    rows = np.zeros((len(places), 8 * _WORDS), np.uint8)
    rows[:, :PREFIX] = buf[places[:, None] + np.arange(PREFIX)]
    return rows.view(">u8").astype(np.uint64)


def suffix_hashes(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for k in range(_WORDS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return h.view(np.int64)


def front_coded(words: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of sorted, different suffixes: lengths of the prefixes shared with the one before, counts (2: more than one), rests."""
    rows = words.astype(">u8").view(np.uint8).reshape(len(words), -1)[:, :PREFIX]
    shared = np.zeros(len(rows), np.uint8)
    shared[1:] = (rows[1:] != rows[:-1]).argmax(1)
    rest = rows[np.arange(PREFIX)[None, :] >= shared[:, None]]
    return struct.pack("<I", len(rows)) + shared.tobytes() + np.minimum(counts, 2).astype(np.uint8).tobytes() + rest.tobytes()


def sorted_run(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes in order, and how often each comes."""
    words = words[np.lexsort(words.T[::-1])]
    new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(1)]))
    return words[new], np.diff(np.append(new, len(words)))


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n, k, step = min(len(a), len(b)), known, 16
    while k + step <= n and a[k : k + step] == b[k : k + step]:
        k += step
    while k < n and a[k] == b[k]:
        k += 1
    return k


def read_run(run: bytes):
    """(suffix, prefix shared with the one before, count) of a run."""
    (n,) = struct.unpack_from("<I", run)
    at, before = 4 + 2 * n, b""
    for k, count in zip(run[4 : 4 + n], run[4 + n : at]):
        to = at + PREFIX - k
        before = before[:k] + run[at:to]
        at = to
        yield before, k, count


def merged(runs: list) -> object:
    """(suffix, prefix shared with the suffix before, count) of all runs in order, by a loser tree.

    A head carries the length of its prefix shared with the last winner. Heads that differ in it
    are ordered without a look at their bytes: the longer is nearer to the last winner, so less.
    """
    size = 1
    while size < len(runs):
        size *= 2
    sources = [iter(r) for r in runs]
    heads: list = [next(s, None) for s in sources] + [None] * (size - len(runs))
    known = [0] * size
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix is then that with the winner."""
        if a < 0 or heads[a] is None:
            return b, a
        if b < 0 or heads[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        k = _shared(x, y, known[a])
        if k == len(x) or k < len(y) and x[k] < y[k]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while winner >= 0 and heads[winner] is not None:
        suffix, _, count = heads[winner]
        yield suffix, known[winner], count
        heads[winner] = next(sources[winner], None)
        if heads[winner] is not None:
            known[winner] = heads[winner][1]  # shared with the one before in its run, which has just won
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _sampled_batches(cuts: np.ndarray):
    """For each range and task a front-coded run (range, run); for each text its anchors (b1, b2, rhs, anchors)."""

    def runs(held: list[np.ndarray]):
        pack = zstandard.ZstdCompressor(level=1).compress
        words, counts = sorted_run(np.concatenate(held))
        piece = np.searchsorted(cuts, words[:, 0], "right")
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        packed = [pack(front_coded(words[a:b], counts[a:b])) for a, b in zip(first, np.append(first[1:], len(words)))]
        n = len(first)
        return pa.RecordBatch.from_arrays(
            [pa.array(piece[first].astype(np.int32)), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))],
            ["range", "run", "b1", "b2", "rhs", "anchors"],
        )

    def work(batches):
        held, rows = [], 0
        for batch in batches:
            texts, b1, b2 = batch.column("text").to_pylist(), batch.column("b1").to_numpy(), batch.column("b2").to_numpy()
            once = np.sort(np.unique(np.stack([b1, b2], 1), axis=0, return_index=True)[1])  # copies of a text within the batch count once
            texts, b1, b2 = [texts[i] for i in once], b1[once], b2[once]
            for lo, hi in chunks_by_bytes(texts):
                buf, offsets = _bytes_of(texts[lo:hi])
                found = anchors(buf, offsets)
                words = suffixes_at(buf, found[:, 1])
                n = hi - lo
                starts = np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)
                rhs = pa.ListArray.from_arrays(pa.array(starts), pa.array(suffix_hashes(words)))
                places = pa.ListArray.from_arrays(pa.array(starts), pa.array((found[:, 1] - offsets[found[:, 0]]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(b1[lo:hi]), pa.array(b2[lo:hi]), rhs, places], ["range", "run", "b1", "b2", "rhs", "anchors"])
                held.append(words)
                rows += len(words)
                if rows >= RUN_ROWS:
                    yield runs(held)
                    held, rows = [], 0
        if rows:
            yield runs(held)

    return work


def _first_words(batches):
    """The first seven bytes of each different anchored suffix of a text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in chunks_by_bytes(texts):
            buf, offsets = _bytes_of(texts[lo:hi])
            first = np.unique(suffixes_at(buf, anchors(buf, offsets)[:, 1])[:, 0] >> np.uint64(8))
            yield pa.RecordBatch.from_arrays([_long(first)], ["w"])


def range_cuts(rows: DataFrame) -> np.ndarray:
    """Bounds (first words) of ranges of about RANGE_ROWS suffixes, four a partition at least, from a sample. They balance the tasks; no result hangs on them."""
    n = rows.count()
    share = min(1.0, max(SAMPLE_TEXTS / max(1, n), 1 / SAMPLE_SHARE))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.select("text").sample(share, 7).mapInArrow(_first_words, "w long")
    seen = first.agg(F.count("*").alias("n"), F.percentile_approx("w", [i / 1024 for i in range(1, 1024)], 20_000).alias("q")).first()
    ranges = max(4 * parts, int(seen["n"] / share / RANGE_ROWS) + 1)
    # between two of the 1023 quantiles (a number that doesn't grow) ranges divide the span evenly
    grid = np.array([0, *(seen["q"] or []), (1 << 56) - 1], np.float64)
    at = np.interp(np.arange(1, ranges) / ranges, np.arange(len(grid)) / (len(grid) - 1), grid)
    return np.unique(at.astype(np.uint64) << np.uint64(8))


def _merge_batches(batches):
    """Hashes of the suffixes that come more than once, from runs sorted by range."""
    unpack = zstandard.ZstdDecompressor().decompress

    def shared(runs):
        found, before, total = [], None, 0
        for suffix, known, count in merged([read_run(unpack(r)) for r in runs]):
            if known == PREFIX and before is not None:
                total += count
            else:
                if total > 1:
                    found.append(before)
                before, total = suffix, count
        if total > 1:
            found.append(before)
        return found

    def out(found):
        buf = np.frombuffer(b"".join(found), np.uint8)
        return pa.RecordBatch.from_arrays([pa.array(suffix_hashes(suffixes_at(buf, np.arange(len(found)) * PREFIX)))], ["rh"])

    now, runs = None, []
    for batch in batches:
        for b, run in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist()):
            if b != now and runs:
                yield out(shared(runs))
                runs = []
            now = b
            runs.append(run)
    if runs:
        yield out(shared(runs))


# ---- resolving starts -------------------------------------------------------------------


def _digest(raw: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(raw, digest_size=16).digest())


def _piece_batches(batches):
    """Pieces (kh, v1, v2, b1, b2, s0, s1) of the starts of the marked anchors."""
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in ("text", "b1", "b2", "marks")}
        out: list[list] = [[] for _ in range(7)]
        for text, b1, b2, marks in zip(*cols.values()):
            raw = (text or "").encode("utf-8", "replace")
            marked = set(marks)
            rows = anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
            for _, a, lo, hi in rows.tolist():
                if a not in marked:
                    continue
                for c in range((a - hi) // CLASS, (a - lo) // CLASS + 1):
                    s0, s1 = max(lo, a - (c + 1) * CLASS + 1), min(hi, a - c * CLASS)
                    base = a - c * CLASS  # all strings of the class hold base .. base + KEY - 1, if it lies in the text
                    kh, _ = _digest(struct.pack("<h", c) + raw[base : base + KEY])
                    v1, v2 = _digest(struct.pack("<hh", base - s0, base - s1) + raw[s0 : s1 + LENGTH])
                    for k, x in enumerate((kh, v1, v2, b1, b2, s0, s1)):
                        out[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["kh", "v1", "v2", "b1", "b2", "s0", "s1"])


def _start_batches(batches):
    """(h1, h2, b1, b2, s) of every start of the pieces that are compared start by start."""

    def hashed(held):
        regions, b1, b2, s0 = zip(*held)
        size = np.array([len(r) for r in regions])
        base = np.cumsum(size) - size
        buf = np.concatenate(regions)
        n = size - LENGTH + 1
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = base[row] + inside
        one, two = (Hashed(buf, values).of(at, at + LENGTH) for values in (_VALUES, _OTHER))
        columns = [_long(one), _long(two), *(_long(np.array(x, np.int64)[row]) for x in (b1, b2)), _long(np.array(s0, np.int64)[row] + inside)]
        return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "b1", "b2", "s"])

    held, total = [], 0
    for batch in batches:
        for text, b1, b2, pieces in zip(*(batch.column(k).to_pylist() for k in ("text", "b1", "b2", "pieces"))):
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            for p in pieces:
                if p["open"]:
                    held.append((raw[p["s0"] : p["s1"] + LENGTH], b1, b2, p["s0"]))
                    total += p["s1"] + LENGTH - p["s0"]
                    if total > SLICE:
                        yield hashed(held)
                        held, total = [], 0
    if held:
        yield hashed(held)


def _span_batches(batches):
    """(b1, b2, spans): the removed stretches of a text, maximal and in order, from the repeated stretches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("gone")  # none is empty
        lo, hi = (x.to_numpy() for x in lists.flatten().flatten())
        text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((lo, text))
        text, lo = text[order], lo[order]
        reach = np.maximum.accumulate((text << 32) + hi[order])  # the furthest end so far; each text begins anew
        new = np.flatnonzero(np.concatenate([[True], (text << 32)[1:] + lo[1:] > reach[:-1]]))
        ends = reach[np.append(new[1:], len(text)) - 1] & 0xFFFFFFFF
        spans = pa.StructArray.from_arrays([pa.array(lo[new]), pa.array(ends)], ["lo", "hi"])
        starts = np.searchsorted(text[new], np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("b1"), batch.column("b2"), pa.ListArray.from_arrays(pa.array(starts), spans)], ["b1", "b2", "spans"])


def _cut_batches(batches):
    """(doc_id, spans, kept) from texts and their spans."""
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, parts, at = text.encode("utf-8", "replace"), [], 0
            for s in spans:
                parts.append(raw[at : s["lo"]])
                at = s["hi"]
            kept.append(b"".join([*parts, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("spans"), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("b1"), F.xxhash64(F.lit("2"), text).alias("b2"))


def _filter_of(marks: DataFrame, key: str):
    """A broadcast bit map of the hashes ``key`` in ``marks``; ``_passes`` is true for all of them and for few others, so that few rows are shuffled.

    A bit map of fixed size (FILTER_BITS) is summed up by Spark and broadcast; as it fills up with a growing
    corpus the test lets more through, which costs a shuffle of more rows and nothing else.
    """
    place = F.pmod(key, F.lit(FILTER_BITS))
    words = marks.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod({key}, {FILTER_BITS}) % 64))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return marks.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % FILTER_BITS
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _maybe_in(marks: DataFrame, key: str):
    shared = _filter_of(marks, key)

    @F.pandas_udf(T.BooleanType())
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(_passes(shared.value, values.to_numpy(np.int64)))

    return test(key)


def _origin_batches(shared):
    """(rh, b1, b2, anchor) of the anchors whose suffix passes the filter."""

    def work(batches):
        for batch in batches:
            rhs, places = batch.column("rhs"), batch.column("anchors")
            h = rhs.flatten().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), np.diff(rhs.offsets.to_numpy()))
            good = np.flatnonzero(_passes(shared.value, h))
            text = text[good]
            columns = [pa.array(h[good]), pa.array(batch.column("b1").to_numpy()[text]), pa.array(batch.column("b2").to_numpy()[text]), pa.array(places.flatten().to_numpy()[good])]
            yield pa.RecordBatch.from_arrays(columns, ["rh", "b1", "b2", "anchor"])

    return work


def shared_suffixes(sampled: DataFrame) -> DataFrame:
    """rh of the anchored suffixes that come more than once in the runs of ``sampled``."""
    parts = int(sampled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = sampled.where("run is not null").select("range", "run")
    return runs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_merge_batches, "rh long")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (the removed stretches lo to hi, in bytes) and kept (the bytes that are left) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows = _named(docs)
    long_rows = rows.where(F.octet_length("text") >= LENGTH)
    sampled = written(long_rows.select("text", "b1", "b2").mapInArrow(_sampled_batches(range_cuts(long_rows)), "range int, run binary, b1 long, b2 long, rhs array<long>, anchors array<int>"))
    shared = written(shared_suffixes(sampled))
    origins = sampled.where("run is null").select("b1", "b2", "rhs", "anchors").mapInArrow(_origin_batches(_filter_of(shared, "rh")), "rh long, b1 long, b2 long, anchor int")
    marks = written(origins.join(shared, "rh", "left_semi").groupBy("b1", "b2").agg(F.collect_set("anchor").alias("marks")))
    texts = long_rows.where(_maybe_in(marks, "b1")).groupBy("b1", "b2").agg(F.first("text").alias("text"))
    table = written(texts.join(marks, ["b1", "b2"]))

    place = F.xxhash64("b1", "b2", "s0")
    pieces = written(table.mapInArrow(_piece_batches, "kh long, v1 long, v2 long, b1 long, b2 long, s0 long, s1 long")).withColumn("place", place)
    contents = pieces.groupBy("kh", "v1", "v2").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    keys = contents.groupBy("kh").agg(F.count("*").alias("contents"))
    live = contents.join(keys, "kh").where("n > 1 or contents > 1")
    told = pieces.join(live, ["kh", "v1", "v2"]).select(
        "b1", "b2", "s0", "s1", (F.col("n") > 1).alias("whole"),
        ((F.col("contents") > 1) & ((F.col("n") == 1) | (F.col("place") == F.col("first")))).alias("open"),
    ).where("whole or open")
    pieces_of = written(told.groupBy("b1", "b2").agg(F.collect_list(F.struct("s0", "s1", "whole", "open")).alias("pieces")))

    opened = table.select("b1", "b2", "text").join(pieces_of.where("exists(pieces, p -> p.open)"), ["b1", "b2"])
    starts = written(opened.mapInArrow(_start_batches, "h1 long, h2 long, b1 long, b2 long, s long"))
    again = written(starts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    single = starts.where(_maybe_in(again, "h1")).join(again, ["h1", "h2"], "left_semi").select("b1", "b2", F.col("s").alias("lo"), (F.col("s") + LENGTH).alias("hi"))
    whole = pieces_of.select("b1", "b2", F.explode("pieces").alias("p")).where("p.whole").select("b1", "b2", F.col("p.s0").alias("lo"), (F.col("p.s1") + LENGTH).alias("hi"))
    gone = single.unionByName(whole).groupBy("b1", "b2").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    spans = gone.mapInArrow(_span_batches, f"b1 long, b2 long, spans {SPANS}")

    copies = long_rows.groupBy("b1", "b2").agg(F.count("*").alias("n")).where("n > 1").select("b1", "b2", F.lit(True).alias("copied"))
    changed = written(spans.join(copies, ["b1", "b2"], "full"))
    # only texts that lose something travel
    maybe = _maybe_in(changed, "b1")
    nothing = F.array().cast(SPANS)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.octet_length("text").cast("long").alias("hi")))
    found = rows.where(maybe).join(changed, ["b1", "b2"], "left").select(
        "doc_id", F.when(F.col("copied"), all_of_it).otherwise(F.coalesce("spans", nothing)).cast(SPANS).alias("spans"), "text"
    )
    kind = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(T.StructType.fromDDL("lo long, hi long"))), T.StructField("kept", T.BinaryType())])
    whole_texts = rows.where(~maybe).select("doc_id", nothing.alias("spans"), F.col("text").cast("binary").alias("kept"))
    return found.mapInArrow(_cut_batches, kind).unionByName(whole_texts)


def _digests() -> list[Column]:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return [
        F.col("doc_id"), (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    ]


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    return cut_repeats(docs).select(*_digests())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"))


def query_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``query``, then spans (lo:hi in bytes, comma-joined) and the text that is left.

    Cuts fall between bytes; what they leave of a character is U+FFFD in ``text``, kept_sha256 is that of the bytes.
    """
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lo"], s["hi"])), ",")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut_repeats(read_table(spark, sf_dir, "documents")).select(*_digests(), spans.alias("spans"), text.alias("text"))
