"""SimHash near-dedup with pivot distance tables.

A fingerprint has bit i set if over half of the XXH64 hashes (seed 42) of a text's word shingles
have it set. Equal fingerprints are one node. Two nodes within RADIUS bits agree on at least
BLOCKS - RADIUS of BLOCKS blocks, so every close pair meets in one of 20 groups of fingerprints
that agree under a mask of three blocks. A group of over ``DENSE`` members is dealt again under masks
that fix half of its remaining bits; such a group has at most 2^17 members whatever the table's
size, since its members are distinct fingerprints.

Inside a group the distances of each member to PIVOTS reference fingerprints are tabulated once.
Members are swept in the order of the first distance; a pair whose distances to any pivot differ
by over RADIUS can't be close (triangle inequality) and is discarded; survivors are verified by
counting differing bits. Pairs that are already connected aren't looked at again, so a group
gives at most one edge per member, and components come out whole.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; rows with a null doc_id take part, but a null never
names a component unless it has no other member; repeated rows come out as often as they go in.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm import fingerprints as minhash
from lakeseek.llm.common import bounded_batches, checkpointed, chunks_by_bytes, mix64, read_table, shingle_hashes
from lakeseek.llm.graph import connected_components

SEED, WIDTH, RADIUS, BLOCKS, PIVOTS, DENSE = 42, 3, 3, 6, 16, 4096
PIECE_BYTES = 1 << 20
BROADCAST_GROUPS = 100_000
_SEPARATOR = re.compile(rb"[\x20\x09-\x0d]")
_ONES = np.uint64(0x0101010101010101)


def _groups_of_bits(bits: list[int], parts: int) -> list[int]:
    """The bits dealt into ``parts`` consecutive blocks, each as a mask."""
    return [sum(1 << b for b in block) for block in np.array_split(bits, parts) for block in [block.tolist()]]


def masks() -> list[int]:
    blocks = _groups_of_bits(list(range(64)), BLOCKS)
    return [sum(c) for c in itertools.combinations(blocks, BLOCKS - RADIUS)]


def finer_masks(mask: int) -> list[int]:
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(c) for c in itertools.combinations(_groups_of_bits(rest, BLOCKS), BLOCKS - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot-{i}".encode(), SEED) for i in range(PIVOTS)], np.uint64)


def _word_runs(text: str | None, width: int):
    """Lists of words whose shingles together are those of the text."""
    raw = (text or "").encode("utf-8", "replace").lower()
    if len(raw) <= PIECE_BYTES:
        yield raw.split()
        return
    at, carry, given = 0, [], False
    while at < len(raw):
        cut = _SEPARATOR.search(raw, at + PIECE_BYTES)
        to = cut.end() if cut else len(raw)
        words = carry + raw[at:to].split()
        if len(words) >= width:
            given = True
            yield words
        carry, at = (words[-(width - 1) :] if width > 1 else []) if len(words) >= width else words, to
    if not given:
        yield carry  # fewer words than a shingle has


def shingle_digests(words: list[bytes], width: int) -> list[int]:
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def _count_bits(counts: np.ndarray, row: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> None:
    """Adds the bits of the hashes to the 64 counts of their texts; ``sizes`` are the lengths of the runs of a text."""
    # runs of at most 255 shingles of one text, so that eight 8-bit counters fit a word
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.flatnonzero(place % 255 == 0)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & _ONES, first)
        np.add.at(counts, (row[first][:, None], np.arange(8)[None, :] * 8 + bit), sums.view(np.uint8).reshape(-1, 8))


def _majority(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(texts: list, width: int = WIDTH) -> np.ndarray:
    """64-bit fingerprints of the texts."""
    rows, sizes, digests = [], [], []
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)

    def flush():
        if not digests:
            return
        h = np.array(digests, np.uint64)
        row = np.repeat(np.array(rows), np.array(sizes))
        _count_bits(counts, row, h, np.array(sizes))
        total[:] += np.bincount(row, minlength=len(texts))
        rows.clear(), sizes.clear(), digests.clear()

    for i, text in enumerate(texts):
        for words in _word_runs(text, width):
            found = shingle_digests(words, width)
            if found:
                rows.append(i), sizes.append(len(found)), digests.extend(found)
            if len(digests) > 200_000:
                flush()
    flush()
    return _majority(counts, total)


def simhash_of(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprints of ``n`` texts whose shingles have the hashes ``h``, by ascending text ``row``."""
    counts, total = np.zeros((n, 64), np.int64), np.bincount(row, minlength=n)
    if len(h):
        _count_bits(counts, row, h, total[total > 0])
    return _majority(counts, total)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [simhash(texts[lo:hi], width) for lo, hi in chunks_by_bytes(texts)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def links(group: np.ndarray, fp: np.ndarray, reference: np.ndarray, radii: tuple[int, ...] = (RADIUS,)) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that connect what pairs of the same group within the largest of ``radii`` bits connect.

    Ascending radii make the edges of a group short ones where it has short ones.
    """
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    parent, us, vs = np.arange(len(fp)), [], []
    sweeps = [(radius, np.arange(len(fp))) for radius in radii]
    step, radius, at = 0, *sweeps.pop(0)
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[(group[at] == group[at + step]) & (table[at + step, 0] - table[at, 0] <= radius)]
        if not len(at):
            if not sweeps:
                break
            step, radius, at = 0, *sweeps.pop(0)
            continue
        i = at[parent[at] != parent[at + step]]
        for lo in range(0, len(i), 1 << 16):
            a = i[lo : lo + (1 << 16)]
            a = a[(np.abs(table[a] - table[a + step]) <= radius).all(1)]
            a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= radius]
            for x in a.tolist():
                p, q = x, x + step
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    us.append(x), vs.append(x + step)
            if len(a):
                parent = _roots(parent)
    return fp[np.array(us, np.int64)], fp[np.array(vs, np.int64)]


def _link_batches(reference: np.ndarray, radii: tuple[int, ...]):
    def edges(held):
        mask, key, fp = (np.concatenate([h[k] for h in held]) for k in range(3))
        group = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        u, v = links(group, fp.view(np.uint64), reference, radii)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def work(batches):
        held, rows = [], 0
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in ("mask", "key", "fp")]
            if not len(now[0]):
                continue
            if held:
                # a group that goes on in this batch stays with its beginning
                last = [h[-1] for h in held[-1]]
                new = np.flatnonzero((now[0] != last[0]) | (now[1] != last[1]))
                cut = int(new[0]) if len(new) else len(now[0])
                if rows + cut > 50_000 and cut < len(now[0]):
                    yield edges([*held, [x[:cut] for x in now]])
                    held, rows, now = [], 0, [x[cut:] for x in now]
            held.append(now)
            rows += len(now[0])
        if held:
            yield edges(held)

    return work


def close_edges(nodes: DataFrame, coarse: list[int] | None = None, finer=finer_masks, radii: tuple[int, ...] = (RADIUS,)) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect the close pairs meeting under a mask.

    With the masks given by default these are all pairs within RADIUS bits.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coarse = coarse or masks()

    def under(mask_list: list[int]):
        return F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in mask_list))

    dealt = nodes.select("fp", F.explode(under(coarse)).alias("at")).select("at.mask", "at.key", "fp")
    dense = checkpointed(dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("mask", "key", F.lit(True).alias("dense")))
    n_dense = dense.count()
    if n_dense:
        # few groups are that large; up to BROADCAST_GROUPS of them (16 bytes each) are broadcast, more are shuffled
        known = dealt.join(F.broadcast(dense) if n_dense <= BROADCAST_GROUPS else dense, ["mask", "key"], "left")
        split = None
        for m in coarse:
            split = F.when(F.col("mask") == _signed(m), under(finer(m))) if split is None else split.when(F.col("mask") == _signed(m), under(finer(m)))
        again = known.where("dense").select("fp", F.explode(split).alias("at")).select("at.mask", "at.key", "fp")
        groups = known.where("dense is null").select("mask", "key", "fp").unionByName(again)
    else:
        groups = dealt
    return groups.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_link_batches(pivots(), radii), "u long, v long")


def _labelled(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (doc_id, fp, ...) with component_id, given the edges between its fingerprints."""
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    star = connected_components(edges)
    named = nodes.join(star, nodes["fp"] == star["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(lowest, "component").select("fp", "component_id")
    return found.join(label, "fp").select("doc_id", "fp", "component_id")


def components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links of RADIUS bits) of every row."""
    found = checkpointed(fingerprints(docs, width))
    return _labelled(found, close_edges(found.select("fp").distinct()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For near copies by likeness. Sets of likeness 0.8 share one of the first fifth (and one) of their shingles in
#: any order common to all; LEAST_KEYS are dealt at least, for short texts all.
LIKENESS, LEAST_KEYS = 0.8, 32
#: Shingles seen in LATE_COUNT of SAMPLE_DOCS texts, at most LATE_MOST of them, come last in the order.
SAMPLE_DOCS, LATE_COUNT, LATE_MOST = 20_000, 3, 200_000
#: Members of a group that are compared in one piece.
NEAR_DENSE = 1024
_PAIRS = np.uint64(0x5555555555555555)
#: Bins in which signatures of that likeness differ at most.
_APART = max(d for d in range(minhash.BINS) if (1 - d / minhash.BINS - 2.0**-minhash.BITS) / (1 - 2.0**-minhash.BITS) >= LIKENESS)


def late_shingles(docs: DataFrame) -> np.ndarray:
    """Common shingles, rarest first, by a sample. They only order the shingles: which pairs meet does not hang on them, the work does."""
    n = docs.count()

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks_by_bytes(texts):
                row, h = shingle_hashes(texts[lo:hi], minhash.WIDTH)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], ["h"])

    seen = docs.select("text").sample(min(1.0, SAMPLE_DOCS / max(1, n)), 1).mapInArrow(work, "h long")
    common = seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LATE_COUNT).orderBy(F.desc("n"), "h").limit(LATE_MOST)
    return common.select("h").toArrow()["h"].to_numpy().view(np.uint64)[::-1].copy()


def first_shingles(row: np.ndarray, h: np.ndarray, n: int, late: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the first distinct shingles of each of ``n`` texts; ``late`` are sorted hashes and their ranks."""
    rank = np.zeros(len(h), np.int64)
    if len(late[0]):
        at = np.minimum(np.searchsorted(late[0], h), len(late[0]) - 1)
        rank = np.where(late[0][at] == h, late[1][at], 0)
    order = np.lexsort((h, rank, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    size = np.bincount(row, minlength=n)
    kept = np.minimum(size, np.maximum(size // 5 + 1, LEAST_KEYS))
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate([[0], np.cumsum(kept)]), h[place < kept[row]]


def _runs(batches, keys: list[str], rows: int = 50_000):
    """The columns of sorted batches as arrays of at least ``rows`` rows that cut no run of equal keys."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and count >= rows:
            last = [held[-1].column(k)[-1].as_py() for k in keys]
            new = np.flatnonzero(np.any([batch.column(k).to_numpy() != x for k, x in zip(keys, last)], axis=0))
            cut = int(new[0]) if len(new) else batch.num_rows
            if cut < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _meetings(batches):
    """Groups of at least two nodes with a key in common, of rows (key, node) sorted so; equal groups of a run once."""
    for table in _runs(batches, ["key"]):
        key, node = (table[k].to_numpy() for k in ("key", "node"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        # named by its members, so that keys with the same members make one group
        name = mix64(np.add.reduceat(mix64(node.view(np.uint64)), first)).view(np.int64)
        _, once = np.unique(name, return_index=True)
        kept = np.zeros(len(first), bool)
        kept[once] = True
        kept &= size > 1
        inside = np.repeat(kept, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[inside]), pa.array(np.repeat(size, size)[inside]), pa.array(node[inside])], ["grp", "n", "node"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a ^ b
    return np.bitwise_count((apart | apart >> np.uint64(1)) & _PAIRS).sum(-1) <= _APART


def alike_forest(sig: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Alike pairs that connect what all alike pairs connect; members of one label are connected already."""
    label, edges = label.copy(), []
    left = len(np.unique(label)) - 1
    for i in range(len(sig) - 1):
        if not left:
            break
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        for x in j[_alike(sig[i], sig[j])].tolist():
            if label[x] != label[i]:
                edges.append((i, x))
                label[label == label[x]] = label[i]
                left -= 1
    return edges


def _verified(batches):
    """Edges between alike nodes of rows (grp, part, node, label, sig) sorted by group and part."""
    for table in _runs(batches, ["grp", "part"]):
        grp, part, node, label = (table[k].to_numpy() for k in ("grp", "part", "node", "label"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint64).reshape(len(node), -1)
        first = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(first, len(grp)))
        twos = first[size == 2]
        twos = twos[label[twos] != label[twos + 1]]
        twos = twos[_alike(sig[twos], sig[twos + 1])]
        us, vs = [twos], [twos + 1]
        for lo, m in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            edges = np.array(alike_forest(sig[lo : lo + m], label[lo : lo + m]), np.int64).reshape(-1, 2) + lo
            us.append(edges[:, 0]), vs.append(edges[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(x)]) for x in (us, vs)], ["u", "v"])


def _alike_pairs(batches):
    """The pairs (u, v) whose signatures a and b are alike."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint64) for k in ("a", "b"))
        yield batch.select(["u", "v"]).filter(pa.array(_alike(a, b), pa.bool_()))


def close_and_alike(found: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes of ``found`` (node, fp) whose SimHash fingerprints link and whose ``sigs`` (node, sig) are alike.

    One node stands for each fingerprint; the other nodes of the fingerprint are held against it, and it against
    those of linked fingerprints. What the check refuses is left to the shingles.
    """
    nodes = checkpointed(found.where(F.length("sig") > 0).select("node", "fp").distinct())
    first = nodes.groupBy("fp").agg(F.min("node").alias("v"))
    same = nodes.join(first, "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    linked = close_edges(nodes.select("fp").distinct()).distinct()
    linked = linked.join(first.select(F.col("fp").alias("u"), F.col("v").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("v").alias("y")), "v")
    pairs = checkpointed(same.unionByName(linked.select(F.col("x").alias("u"), F.col("y").alias("v"))).distinct())
    signed = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v")
    return checkpointed(signed.select("u", "v", "a", "b").mapInArrow(_alike_pairs, "u long, v long"))


def alike_edges(found: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the alike nodes of ``found`` (node, fp, sig, keys). Only verified pairs connect.

    Links of SimHash fingerprints come first; members of a shingle's group that they have connected are not compared again.
    A group of over NEAR_DENSE members is first compared in random parts. If that leaves it in several
    components, members outside its largest are compared with all, block by block.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = checkpointed(found.where(F.length("sig") > 0).select("node", "sig").distinct())
    close = close_and_alike(found, sigs)
    # the least node linked names a node: equal names are connected, and no rounds over all links are needed
    both = close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label"))
    labelled = sigs.join(star, "node", "left").select("node", "sig", F.coalesce("label", "node").alias("label"))
    dealt = found.select("node", "keys").distinct().select(F.explode("keys").alias("key"), "node")
    met = dealt.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_meetings, "grp long, n long, node long")
    met = checkpointed(met.distinct())

    def verified(rows: DataFrame) -> DataFrame:
        named = rows.join(sigs if "label" in rows.columns else labelled, "node")
        return named.select("grp", "part", "node", "label", "sig").repartition(parts, "grp", "part").sortWithinPartitions("grp", "part", "node").mapInArrow(_verified, "u long, v long")

    def pieces(rows):
        return F.ceil(rows / F.lit(NEAR_DENSE)).cast("long")

    draw = F.xxhash64("grp", "node")
    edges = checkpointed(close.unionByName(verified(met.select("grp", F.pmod(draw, pieces(F.col("n"))).alias("part"), "node"))).distinct())
    dense = met.where(F.col("n") > NEAR_DENSE)
    if not dense.limit(1).count():
        return edges
    star = connected_components(edges).withColumnRenamed("node", "named")
    placed = checkpointed(dense.join(star, dense["node"] == star["named"], "left").select("grp", "n", "node", F.coalesce("component", "node").alias("label")))
    counts = placed.groupBy("grp", "label").agg(F.count("*").alias("m"))
    main = counts.groupBy("grp").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("n")).where(F.col("n") > F.col("top.m"))
    main = checkpointed(main.select("grp", F.col("top.label").alias("main"), pieces(F.col("n") - F.col("top.m")).alias("outer"), pieces(F.col("top.m")).alias("inner")))
    n_open = main.count()
    if not n_open:
        return edges
    rest = placed.drop("n").join(F.broadcast(main) if n_open <= BROADCAST_GROUPS else main, "grp")
    own = F.pmod(draw, F.when(F.col("label") == F.col("main"), F.col("inner")).otherwise(F.col("outer")))
    blocks = lambda of, part: F.transform(F.sequence(F.lit(0).cast("long"), F.col(of) - 1), part)
    # (0, a, b): two blocks outside the largest component; (1, a, b): one outside and one inside
    outside = F.concat(blocks("outer", lambda o: F.xxhash64(F.lit(0), F.least(o, own), F.greatest(o, own))), blocks("inner", lambda o: F.xxhash64(F.lit(1), own, o)))
    inside = blocks("outer", lambda o: F.xxhash64(F.lit(1), o, own))
    dealt = rest.select("grp", F.explode(F.when(F.col("label") == F.col("main"), inside).otherwise(outside)).alias("part"), "node", "label")
    return edges.unionByName(verified(dealt))


def _near_components(docs: DataFrame) -> DataFrame:
    """row (struct of doc_id and text hash, null for a null doc_id) and component (the least such struct) over near copies."""
    bounded_batches(docs.sparkSession)
    last = late_shingles(docs)
    order = np.argsort(last)
    late = (last[order], order + 1)

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks_by_bytes(texts):
                row, h = shingle_hashes(texts[lo:hi], minhash.WIDTH)
                sigs = [bytes.fromhex(x) for x in minhash.packed(*minhash.signatures(texts[lo:hi], (row, h)))]
                fp = simhash_of(*shingle_hashes(texts[lo:hi], WIDTH), hi - lo).view(np.int64)
                offsets, first = first_shingles(row, h, hi - lo, late)
                node = np.array([xxhash.xxh64_intdigest(x, SEED) for x in sigs], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(first.view(np.int64)))
                own = [batch.column(k).slice(lo, hi - lo) for k in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node), pa.array(fp), pa.array(sigs, pa.binary()), lists], ["doc_id", "text_hash", "node", "fp", "sig", "keys"])
        pa.default_memory_pool().release_unused()

    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("text_hash", T.LongType()), ("node", T.LongType()), ("fp", T.LongType()), ("sig", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]
    named = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    found = checkpointed(named.mapInArrow(work, T.StructType([T.StructField(*k) for k in kinds])))
    edges = alike_edges(found.select("node", "fp", "sig", "keys"))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    labelled = _labelled(found.select(row.alias("doc_id"), F.col("node").alias("fp")), edges)
    return labelled.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id over links of five-word shingles with a likeness of 0.8 or more.

    The likeness is that of one-permutation MinHash signatures; rows of equal signatures are one node.
    SimHash links (RADIUS bits, by masks and pivot distances) connect near copies first, each checked by
    likeness. Near copies may lie further apart, so texts also meet under each of their first shingles (see
    LIKENESS): no pair of shingle sets of that likeness is missed, and members of a group that the SimHash
    links have not connected are connected by verified pairs alone.
    """
    return _near_components(docs).select("row.doc_id", F.col("component.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row of the least doc_id (then text hash); rows with a null doc_id all stay.

    Rows are told apart by doc_id and text, so of repeated ids with different texts each stays unless it is a
    near copy of another; of repeated rows with one text one stays. The texts are shuffled once, for the anti
    join and the choice among repeated rows.
    """
    dropped = _near_components(docs).where(F.col("row").isNotNull() & (F.col("row") != F.col("component"))).select("row.doc_id", F.col("row.text_hash").alias("hashed")).distinct()
    nth, hashed = "nth", "hashed"
    while {nth, hashed} & set(docs.columns):
        nth, hashed = nth + "_", hashed + "_"
    order = Window.partitionBy("doc_id", hashed).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = docs.where("doc_id is not null").withColumn(hashed, text_hash(F.col("text"))).join(dropped.withColumnRenamed("hashed", hashed), ["doc_id", hashed], "left_anti")
    once = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionByName(docs.where("doc_id is null").select(*columns))
