import hashlib

from lakeseek.llm import fingerprints

SCHEMA = "doc_id long, text string, lang string, block int, role string"


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    least = {i: min(r[1] or "" for r in rows if r[0] == i) for i in ids}
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        nxt = "" if doc_id is None else least[ids[(ids.index(doc_id) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        out.append((doc_id, len(text), edited, nxt, text))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], "en", 1, "x") for r in rows], SCHEMA)
    return fingerprints.with_edits(df).collect()


def test_edges(spark):
    long = " ".join(f"w{i % 977}é" for i in range(60_000))
    rows = [(5, "a b c d e f g h i j"), (1, None), (9, ""), (5, "a b c"), (2, long), (None, "no id at all here now"), (7, "one two\tthree four five six 🙂 seven"), (7, "one two\tthree four five six 🙂 seven")]
    got = {}
    for r in run(spark, rows):
        got.setdefault((r.doc_id, r.n_chars), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, n, edited, nxt, text in expected(rows):
        r = got[doc_id, n][0]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, edited)) < 0.12
        assert abs(r.near_next - jaccard(text, nxt)) < 0.12
    assert got[7, 35][0].fingerprint == got[7, 35][1].fingerprint
    assert got[1, 0][0].fingerprint == ""


def test_one_row_and_none(spark):
    (r,) = run(spark, [(3, "abcdefgh")])
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert run(spark, []) == []


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {x[0]: x for x in expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])}
    got = fingerprints.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    errors = []
    for r in got:
        _, n, edited, nxt, text = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, nxt))]
    assert sum(errors) / len(errors) < 0.02 and max(errors) < 0.15
