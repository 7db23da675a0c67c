import random

import numpy as np
import xxhash

from lakeseek.llm import graph, simhash


def slow_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fp = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fp)), key=repr)


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(i, t, "en", 5) for i, t in rows], "doc_id long, text string, lang string, component_id int")
    got = simhash.components(df)
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()), key=repr)


def test_edges(spark):
    rows = [(4, None), (3, " \t\n"), (9, "One two"), (8, "one\x0btwo"), (7, "é\xa0b c d"), (7, "é\xa0b c d"), (None, "lone row here for me"), (None, "one two"), (2, "x y z")]
    assert run(spark, rows) == slow_components(rows)
    assert run(spark, []) == []


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(3000))
    whole = simhash.simhash([text, "a b", text])
    monkeypatch.setattr(simhash, "PIECE_BYTES", 100)
    assert (simhash.simhash([text, "a b", text]) == whole).all() and int(whole[0]) == slow_fingerprint(text)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == slow_components(rows)


def test_links_of_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 5)
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    star = {r.node: r.component for r in graph.connected_components(simhash.close_edges(df)).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    got, want = {}, {}
    for f in fps:
        got.setdefault(star.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
        want.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_near_copies_by_likeness(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))
    rows, groups = [], []
    for g in range(60):
        base = [word() for _ in range(rng.randint(150, 500))]
        rows.append((10 * g, " ".join(base)))
        if g % 2:
            copy = list(base)
            for _ in range(max(1, len(base) // 80)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((10 * g + 1, " ".join(copy)))
            groups.append(10 * g + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert all(got[i] in (i, i - 1) if i % 10 else got[i] == i for i, _ in rows)
    assert sum(got[i] == i - 1 for i in groups) >= 0.95 * len(groups)


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "something else is here now"), (3, "something else is here now"), (None, "a b c d")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, nth int")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, None], key=repr)
    assert (np.bitwise_count(simhash.pivots()) > 16).all()


def test_one_of_each_keeps_repeated_ids_with_other_texts(spark):
    rows = [(1, "first words of one text here"), (1, "quite another text under the same id"), (2, "first words of one text here"), (2, "a third text that stands alone here"), (None, "quite another text under the same id"), (1, None), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=repr)
    assert got == sorted({rows[0], rows[1], rows[3], rows[4], rows[5]}, key=repr)


def test_few_words_over_a_piece(spark):
    text = "w" * (simhash.PIECE_BYTES + 9) + " b c"
    assert list(simhash._word_runs(text, 4)) == [[w.encode() for w in text.split()]]
    assert simhash.simhash([text], 4)[0] == int(simhash.simhash([text], 3)[0]) != 0
    assert simhash.simhash([" " * (simhash.PIECE_BYTES + 9)])[0] == 0


def near_pairs(spark, rows):
    """Components of near_copies, and of brute force over the same signatures."""
    low, has = simhash.minhash.signatures([t for _, t in rows])
    label = list(range(len(rows)))
    for a in range(len(rows)):
        alike = simhash.minhash.likeness(low, has, np.repeat(low[a : a + 1], len(rows), 0), np.repeat(has[a : a + 1], len(rows))) >= 0.8
        for b in np.flatnonzero(alike).tolist():
            x, y = label[a], label[b]
            if x != y:
                label = [min(x, y) if k in (x, y) else k for k in label]
    want = {i: rows[label[k]][0] for k, (i, _) in enumerate(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}, want


def chain(rng, name, n, step, length):
    """Texts of ``n`` words, each without the first ``step`` words of the one before."""
    line = [f"{name}{rng.getrandbits(40):x}" for _ in range(n + step * length)]
    return [" ".join(line[k * step : k * step + n]) for k in range(length)]


def test_unlike_neighbours_hide_no_near_copy(spark):
    rng = random.Random(21)
    # likeness 0.88 to one text and 0.68 to two others within 14 bits, in many families
    texts = []
    for g in range(60):
        base = [f"g{g}w{rng.getrandbits(30):x}" for _ in range(300)]
        for share in (0, 12, 40, 44, 48):
            new = list(base)
            new[150 - share : 150 + share] = [f"x{rng.getrandbits(40):x}" for _ in range(2 * share)]
            texts.append(" ".join(new))
    got, want = near_pairs(spark, list(enumerate(texts)))
    assert got == want


def test_equal_simhash_is_no_copy(spark):
    rng = random.Random(22)
    line = " ".join(f"w{rng.getrandbits(30):x}" for _ in range(15))
    rows = [(i, f"{(line + ' ') * 300}" + " ".join(f"t{rng.getrandbits(40):x}" for _ in range(80))) for i in range(12)]
    assert len(set(simhash.simhash([t for _, t in rows], 5).tolist())) == 1
    got, want = near_pairs(spark, rows)
    assert got == want == {i: i for i in range(12)}


def test_no_near_copy_is_missed(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_DENSE", 8, raising=False)
    rng = random.Random(23)
    passage = " ".join(f"p{rng.getrandbits(30):x}" for _ in range(60))
    rows = [(1000, None), (1001, " \n"), (1002, "a b"), (1003, "A  b"), (1004, "a b c d e f g")]
    for g in range(60):
        base = [f"g{g}w{rng.getrandbits(30):x}" for _ in range(rng.choice([8, 30, 90, 300]))]
        for k in range(4):
            new = list(base)
            for at in rng.sample(range(len(new)), round(0.006 * k * len(new))):
                new[at] = f"x{rng.getrandbits(40):x}"
            rows.append((len(rows), f"{passage * (g % 2)} {' '.join(new)}"))
    rows += [(2000 + i, t) for i, t in enumerate(chain(rng, "c", 200, 10, 40))]
    got, want = near_pairs(spark, rows)
    assert got == want
    monkeypatch.setattr(simhash, "NEAR_DENSE", 4096)
    assert near_pairs(spark, rows)[0] == got


def test_near_copies_are_linked_by_simhash(spark, monkeypatch):
    """Without meetings by shingles the stage still finds what is alike within 3 bits, and only that."""
    rng = random.Random(24)
    rows = []
    for g in range(40):
        base = [f"g{g}w{rng.getrandbits(30):x}" for _ in range(400)]
        rows.append((2 * g, " ".join(base)))
        new = list(base)
        new[rng.randrange(400)] = "x"
        rows.append((2 * g + 1, " ".join(new)))
    line = " ".join(f"w{rng.getrandbits(30):x}" for _ in range(15))  # equal fingerprints, unlike texts
    rows += [(100 + i, f"{(line + ' ') * 300}" + " ".join(f"t{rng.getrandbits(40):x}" for _ in range(80))) for i in range(6)]
    fps = simhash.simhash_of(*simhash.shingle_hashes([t for _, t in rows], simhash.WIDTH), len(rows))
    close = {i for i, t in rows[1:80:2] if int(fps[i] ^ fps[i - 1]).bit_count() <= 3}
    assert len(close) > 20 and len(set(fps[80:].tolist())) == 1
    monkeypatch.setattr(simhash, "first_shingles", lambda row, h, n, late: (np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in got if got[i] != i} == close and all(got[i] == i - 1 for i in close)
