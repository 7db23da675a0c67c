import hashlib
import random
from collections import Counter

import numpy as np

from lakeseek.llm import suffixes as sx
from lakeseek.llm.catalog import QUERIES


def slow(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[s : s + 400] for r in raw for s in range(len(r) - 399))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        end = 0
        for s in range(len(r) - 399):
            if seen[r[s : s + 400]] > 1:
                gone[max(s, end) : s + 400] = True
                end = s + 400
        flags = gone[:-1]
        spans = int((flags & ~np.concatenate([[False], flags[:-1]])).sum()) if len(r) else 0
        kept = bytes(b for b, g in zip(r, flags) if not g)
        out.append((len(r), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, b1 string, n_removed int")
    return sorted([tuple(r) for r in sx.without_repeats(df).collect()], key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "é", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_edges(spark):
    rng = random.Random(1)
    common, line = words(rng, 200), words(rng, 40)[:380]
    exact = ("q" + words(rng, 100))[:399]
    rows = [(1, None), (2, ""), (3, "a" * 5000), (4, "ab" * 300), (5, words(rng, 100)), (5, words(rng, 100)), (6, common), (7, common), (8, words(rng, 90) + common + words(rng, 90)),
            (9, words(rng, 30) + common[50:600] + words(rng, 20) + common[550:]), (10, words(rng, 50) + exact + "x" + words(rng, 50)), (11, words(rng, 50) + exact + "x"), (12, exact + "y"),
            (13, exact), (None, common[:401]), (14, "z" * 399), (15, words(rng, 9000)), (16, "🙂" * 101)]
    rows += [(20 + i, words(rng, rng.randint(0, 60)) + line + words(rng, rng.randint(0, 60))) for i in range(12)]
    rows += [(40 + i, words(rng, rng.randint(0, 60)) + common[: 395 + i] + words(rng, rng.randint(0, 60))) for i in range(12)]
    base = words(rng, 900).split()
    for i in range(8):
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        rows.append((60 + i, " ".join(copy)))
    want = sorted([(i, *x) for (i, _), x in zip(rows, slow([t for _, t in rows]))], key=repr)
    assert run(spark, rows) == want
    assert run(spark, []) == []


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(2)
    buf, offsets = sx._bytes_of([words(rng, 700), "", words(rng, 20), words(rng, 2000), "a" * 3000])
    whole = sx.anchors(buf, offsets)
    monkeypatch.setattr(sx, "SLICE", 700)
    assert (sx.anchors(buf, offsets) == whole).all()
    assert (whole[:, 3] - whole[:, 2] < sx.WINDOW).all()


def test_anchors_are_the_leftmost_least_grams():
    rng = random.Random(4)
    texts = [words(rng, 300), "a" * 900, "ab" * 300, ("-" * 90 + "\n") * 12, words(rng, 3), "z" * 400]
    buf, offsets = sx._bytes_of(texts)
    h = sx.gram_hashes(buf).tolist()
    want = []
    for t, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        for s in range(lo, hi - sx.LENGTH + 1):
            window = h[s : s + sx.WINDOW]
            a = s + window.index(min(window))
            if want and want[-1][:2] == [t, a]:
                want[-1][3] = s
            else:
                want.append([t, a, s, s])
    assert sx.anchors(buf, offsets).tolist() == want


def test_loser_tree_orders_and_never_looks_twice(monkeypatch):
    rng = random.Random(3)
    looked = []
    plain = sx._shared
    monkeypatch.setattr(sx, "_shared", lambda a, b, k: looked.append(plain(a, b, k) - k) or k + looked[-1])
    for n in (1, 2, 3, 7):
        runs = [sorted({bytes(rng.choice(b"ab\xff\0") for _ in range(12)).ljust(sx.PREFIX, rng.choice([b"x", b"\0"])) for _ in range(rng.randint(0, 40))}) for _ in range(n)]
        looked.clear()
        words = [sx.suffixes_at(np.frombuffer(b"".join(r), np.uint8), np.arange(len(r)) * sx.PREFIX) for r in runs if r]
        coded = [sx.front_coded(*sx.sorted_run(w[np.random.default_rng(n).permutation(len(w))])) for w in words]
        got = list(sx.merged([sx.read_run(c) for c in coded]))
        want = sorted(s for r in runs for s in r)
        assert [s for s, *_ in got] == want
        for (a, *_), (b, k, _) in zip(got, got[1:]):
            assert k == plain(a, b, 0)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, slow([d.text for d in docs]))]
    assert sorted(tuple(r) for r in sx.query(spark, "/root/testdata/sf0.001").collect()) == want


def test_texts_and_spans_that_are_left(spark):
    rng = random.Random(5)
    common = words(rng, 120)  # over 50 words, over 400 bytes
    rows = [(1, words(rng, 80) + common + words(rng, 80)), (2, words(rng, 60) + common), (3, words(rng, 300)), (4, "é" * 300), (4, "xé" + "é" * 300), (5, common * 2), (6, common * 2), (7, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, [(s.lo, s.hi) for s in r.spans], bytes(r.kept)) for r in sx.cut_repeats(df).collect()), key=repr)
    raw = {t: (t or "").encode() for _, t in rows}
    seen = Counter(r[s : s + 400] for _, t in rows for r in [raw[t]] for s in range(len(r) - 399))
    want = []
    for i, t in rows:
        spans = []
        for s in range(len(raw[t]) - 399):
            if seen[raw[t][s : s + 400]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], s + 400)
                else:
                    spans.append((s, s + 400))
        kept, at = b"", 0
        for lo, hi in spans:
            kept, at = kept + raw[t][at:lo], hi
        want.append((i, spans, kept + raw[t][at:]))
    assert got == sorted(want, key=repr)
    assert all(common.encode() not in kept for _, _, kept in got) and (3, [], raw[rows[2][1]]) in got


def test_registered_query_returns_texts(spark):
    rows = QUERIES["op5_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {d.doc_id: d.text or "" for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    cut = 0
    for r in rows:
        raw, kept, at = texts[r.doc_id].encode(), b"", 0
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        for lo, hi in spans:
            kept, at = kept + raw[at:lo], hi
        kept += raw[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        assert r.text == kept.decode("utf-8", "replace")
        cut += bool(spans)
    assert len(rows) == len(texts) and 0 < cut < len(rows)
