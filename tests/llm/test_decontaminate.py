import random

from lakeseek.llm import decontaminate as dc


def slow_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, text, share):
    out = []
    for c in text:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(rng.choice("abcdefghij ") if r < 2 * share / 3 else c)
        if 2 * share / 3 <= r < share:
            out.append(rng.choice("abcdefghij"))
    return "".join(out)


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_distance():
    rng = random.Random(2)
    for _ in range(150):
        a, b = words(rng, rng.randint(2, 9)), words(rng, rng.randint(0, 14))
        b = b + edited(rng, a, 0.2) + b if rng.random() < 0.5 else b
        assert dc.distance_within(a, b) == slow_distance(a, b)


def test_recall_and_precision():
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(15, 59))) for i in range(120)]
    index = dc.Index(items)
    for share, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.9)):
        texts = [f"{words(rng, rng.randint(0, 200))} {edited(rng, t, share)} {words(rng, rng.randint(0, 200))}" for _, t in items]
        hits = index.hits(texts)
        assert sum(k in h for k, h in enumerate(hits)) >= least * len(items)
        for k, h in enumerate(hits):
            for j, like in h.items():
                assert abs(like - (1 - slow_distance(dc.normal(items[j][1]).decode(), dc.normal(texts[k]).decode()) / len(items[j][1]))) < 0.1
                assert j == k
    assert not any(index.hits([words(rng, 300) for _ in range(200)]))


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(20)]
    text = " ".join(words(rng, 60) + " " + t for _, t in items)
    monkeypatch.setattr(dc, "PIECE_BYTES", 500)
    assert set(dc.Index(items).hits([text])[0]) == set(range(20))


def test_dataframes(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, words(rng, 25)) for i in range(6)] + [(6, None), (7, "too short"), (8, ""), (0, words(rng, 20))]
    rows = [(1, f"x {items[0][1].upper()} y"), (2, None), (3, ""), (4, words(rng, 100)), (5, items[1][1]), (5, items[1][1]), (None, items[2][1] + " " + items[3][1]), (9, "too short")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, item_id int, likeness string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 0, 1.0), (5, 1, 1.0), (5, 1, 1.0), (None, 2, 1.0), (None, 3, 1.0)], key=repr)
    assert sorted(map(tuple, dc.leaks(df, bench).collect()), key=repr) == want
    blocks = dc.item_blocks
    monkeypatch.setattr(dc, "item_blocks", lambda items: blocks(items, 400))
    assert sorted(map(tuple, dc.leaks(df, bench).collect()), key=repr) == want
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 9]
    assert dc.leaks(df.limit(0), bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0
    assert dc.clean(df, bench.limit(0)).count() == len(rows)


def test_whole_table_against_substrings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if dc.normal(b.text) in dc.normal(d.text)}
    got = {(r.doc_id, r.item_id): r.likeness for r in dc.query(spark, "/root/testdata/sf0.01").collect()}
    assert want == {k for k, like in got.items() if like == 1.0}
    texts, items = {d.doc_id: d.text for d in docs}, {b.item_id: b.text for b in bench}
    for (d, i), like in got.items():
        assert dc.distance_within(dc.normal(items[i]).decode(), dc.normal(texts[d]).decode()) <= 0.2 * len(dc.normal(items[i]).decode()) and like >= 0.8


def test_short_items():
    rng = random.Random(12)
    items = [(0, "a b c d e"), (1, "to be or not to be"), (2, "the cat sat on my mat"), (3, "é à ü ö ä î"), (4, "who let these dogs out at noon"), (5, f"{'x' * 90} a b c d")]
    index = dc.Index(items)
    around = lambda: words(rng, 40)
    for i, text in items:
        assert index.hits([f"{around()} {text} {around()}"])[0].get(i) == 1.0
    assert 1 in index.hits([f"{around()} to be ox not to be {around()}"])[0]


def test_verbatim_items_of_short_words():
    rng = random.Random(13)
    items = [(i, " ".join(rng.choice(["a", "of", "the", "an", "is", "be", "we", "it", "go", "cat"]) for _ in range(25))) for i in range(200)]
    hits = dc.Index(items).hits([f"{words(rng, 30)} {t} {words(rng, 30)}" for _, t in items])
    assert all(h.get(i) == 1.0 for i, h in enumerate(hits))
    # collisions in all repetitions at offsets 0, 4 and 8, as in a short clean stretch
    index = dc.Index([(0, "abc def ghi jkl mno pqr stu vwx yza bcd efg hij klm nop qrs tuv")])
    text = dc.normal("abc def ghi jkl mno pqr stu vwx") + b"\0" * (dc.STEPS + 1)
    found = index._collisions(dc.np.frombuffer(text, dc.np.uint8), dc.np.array([0, len(text)]))
    assert [0, 0, 0] in found


def test_edited_items_without_whole_words():
    rng = random.Random(14)
    text = "planet silver garden window bridge stones"
    leaked = "xx planat silvor gardan windaw bridga stonas yy"
    assert dc.Index([(0, text)]).verified(leaked.encode(), {(0, 3)}) == {0: 1 - 6 / len(text)}
    item = words(rng, 30)
    stretch = ("z" * 40 + item).encode()
    # the first place is checked in vain, the second holds the passage
    first = 40 - len(item) // 5 - 16 - 10
    assert dc.Index([(0, item)]).verified(stretch, {(0, first - len(item) // 2), (0, first), (0, 40)}) == {0: 1.0}
    around = lambda: words(rng, 40)
    for _ in range(150):
        text = words(rng, rng.randint(5, 9))[:47].rsplit(" ", 1)[0]
        if len(text.split()) < 5:
            continue
        leaked = f"{around()} {edited(rng, text, 0.15)} {around()}"
        like = 1 - slow_distance(text, dc.normal(leaked).decode()) / len(text)
        assert dc.Index([(0, text)]).hits([leaked])[0] == ({0: like} if like >= 0.8 else {})


def test_recall_against_every_pair(spark):
    """All items against all documents of up to 6000 characters by edit distance; only a lossless gram count spares pairs."""
    docs = [(r.doc_id, dc.normal(r.text).decode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, dc.normal(r.text).decode()) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(8)
    docs = [(i, t) for i, t in docs if len(t) <= 6000]
    docs += [(10_000 + k, f"{words(rng, 40)} {edited(rng, t, 0.12)} {words(rng, 40)}") for k, (_, t) in enumerate(items)]
    grams = lambda t: [t[i : i + dc.GRAM] for i in range(len(t) - dc.GRAM + 1)]
    want, sets = set(), [(i, t, set(grams(t))) for i, t in docs]
    for item, target in items:
        own = grams(target)
        least = len(own) - dc.GRAM * (len(target) // 5)
        want |= {(i, item) for i, t, s in sets if sum(g in s for g in own) >= least and 1 - dc.distance_within(target, t) / len(target) >= dc.LIKENESS}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(f"x{i}", t) for i, t in items], "item_id string, text string")
    got = {(r.doc_id, int(r.item_id[1:])) for r in dc.leaks(df, bench).collect()}
    assert len(want) > 40 and got <= want and len(got) >= 0.9 * len(want)
