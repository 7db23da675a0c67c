import sentencepiece

import corpus_pipeline as cp
from lakeseek.llm import decontaminate, langid, pieces, pii


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_plain_python(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = langid.train(langid.training_rows(docs))
    texts = {r.doc_id: r for r in docs.collect()}
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = None
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r for r in docs.collect()}
        assert len(rows) == docs.count()
        if name != "tokens":
            assert docs.columns == columns
        if name == "language_id":
            found, sure = langid.score([r.text for r in before.values()], *model)
            assert set(rows) == {i for i, f, s in zip(before, found, sure) if f != "und" and s >= cp.LEAST_SCORE}
        if name == "near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            pairs = [(a, b) for a in sets for b in sets if a < b and like(a, b) >= 0.85]
            assert sum(a in rows and b in rows for a, b in pairs) <= 0.1 * len(pairs)
            lone = [a for a in sets if all(a == b or like(a, b) < 0.6 for b in sets)]
            assert all(a in rows for a in lone)
        if name == "decontamination":
            gone = set(before) - set(rows)
            assert {i for i, r in before.items() if any(b in decontaminate.normal(r.text) for b in bench if len(b.split()) >= 5)} <= gone
        if name == "redaction":
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert r.n_chars == len(r.text) and (r.text == before[i].text or "[" in r.text)
                assert before[i].lang == r.lang
            kept = rows
        if name == "tokens":
            theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert {i: list(r.ids) for i, r in rows.items()} == {i: theirs.encode(r.text) for i, r in kept.items()}
    assert 0 < len(kept) < len(texts)


def test_run_equals_its_stages(spark):
    rows = [(1, "the cat and the dog are in the house of the man", "en", "s", 10), (2, "the cat and the dog are in the house of the man", "en", "s", 10), (3, None, "en", "s", 0), (4, "le chat et le chien sont dans la maison +1 (988) 555-2485", "fr", "s", 9), (None, "the man is in the house and the dog", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = df
    for _, stage in cp.STAGES[:2]:
        docs = stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "4", "None"]
    assert "[PHONE]" in {r.doc_id: r.text for r in cp.redaction(spark, docs, "").collect()}[4]
    assert pii.redacted(df).columns == df.columns
    for _, stage in cp.STAGES[:2] + cp.STAGES[3:]:
        assert stage(spark, df.limit(0), "").count() == 0
