import math
import zlib
from collections import Counter, defaultdict

from lakeseek.llm import langid


def test_held_out_accuracy(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int, lang_pred string"
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 !!", None), (None, "the dog", "de"), (5, "the dog " * 300_000, None), (6, "", "en")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    model = langid.train(df.where("doc_id < 3"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[5].lang_pred, got[None].lang_pred) == ("en", "fr", "en", "en")
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (3, 4, 6))
    assert langid.train(df.limit(0))[0] == []
    assert {r.lang_pred for r in langid.predict(df, langid.train(df.limit(0))).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    kept = langid.keep_identified(df, model, 0.5)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 5}


def test_pieces_change_nothing(spark, monkeypatch):
    text = "Ünder the bridge, été comme hiver. " * 50
    whole = sorted((int(b) for _, bs in langid.ngrams([text]) for b in bs))
    monkeypatch.setattr(langid, "PIECE_CHARS", 64)
    assert whole == sorted((int(b) for _, bs in langid.ngrams([text]) for b in bs))


def test_against_plain_naive_bayes(spark):
    """The same model with whole n-grams in dictionaries: no hashing, no matrix, no batches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()

    def grams(text):
        t = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
        for i in range(len(t) - 2):
            if t[i : i + 2].strip():
                yield t[i : i + 2]
            if t[i + 1] != " ":
                yield t[i : i + 3]

    counts = defaultdict(Counter)
    for d in docs:
        if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            counts[d.lang].update(grams(d.text))
    total = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r.lang_pred for r in langid.query(spark, "/root/testdata/sf0.001").collect()}
    same = 0
    for d in docs:
        g = Counter(grams(d.text))
        sums = {lang: sum(n * math.log((c[x] + langid.SMOOTHING) / total[lang]) for x, n in g.items()) for lang, c in counts.items()}
        want = max(sorted(sums), key=sums.get) if any(x.strip() for x in g) else "und"
        same += got[d.doc_id] == want
    assert same >= 0.99 * len(docs)
