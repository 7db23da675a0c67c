import math

import pytest
from pyspark.sql import functions as F

from lakeseek.operators import bm25, cache, fusion, metrics, observe

CHUNK = "tenant_id string, chunk_id string, text string, acl_tags array<string>, collection_id string, seq long"
QUERY = "query_id int, question string, tenant_id string, caller_tags array<string>, query_collection string"


def slow_bm25(corpus, question):
    docs = [d.lower().split() for d in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in question.lower().split()) for d in docs]


def test_scores_and_padding(spark):
    texts = ["alpha beta", "alpha beta", "gamma delta gamma", "zeta", "eta theta"]
    chunks = spark.createDataFrame([("t", f"c{i}", x, [] if i != 3 else ["board"], None, i) for i, x in enumerate(texts)] + [("u", "other", "gamma gamma gamma", [], None, 0)], CHUNK)
    q = spark.createDataFrame([(1, "Gamma gamma alpha", "t", [], None), (2, "", "t", [], None), (3, "gamma", "nobody", [], None), (4, "zeta", "t", [], None)], QUERY)
    rows = bm25.top_k(q, chunks, 4).orderBy("query_id", "rank").collect()
    want = slow_bm25(texts, "gamma gamma alpha")
    first = [(r.chunk_id, r.score) for r in rows if r.query_id == 1]
    order = sorted([i for i in range(5) if i != 3], key=lambda i: (-round(want[i], 9), i))
    assert [c for c, _ in first] == [f"c{i}" for i in order]
    assert all(abs(s - want[int(c[1:])]) < 1e-8 for c, s in first)
    assert {r.query_id for r in rows} == {1, 4}
    assert [r.chunk_id for r in rows if r.query_id == 4] == ["c0", "c1", "c2", "c4"]


def test_add_keeps_places_and_delete(spark):
    index = spark.createDataFrame([("t", "a", "x", [], None, 0), ("t", "b", "y", [], None, 1)], CHUNK)
    new = spark.createDataFrame([("t", "a", "X2", [], None, 5), ("t", "c", "z", [], None, 6), ("u", "d", "w", [], None, 0)], CHUNK)
    assert sorted((r.chunk_id, r.text, r.seq) for r in bm25.added(index, new).collect()) == [("a", "X2", 0), ("b", "y", 1), ("c", "z", 2), ("d", "w", 0)]
    assert [r.chunk_id for r in bm25.removed(index, new).collect()] == ["b"]


def test_fusion_ties_and_components(spark):
    rows = [(1, "dense", "ch_b", 1.0), (1, "dense", "ch_a", 1.0), (1, "sparse", "ch_b", 3.0)]
    got = fusion.fuse(spark.createDataFrame(rows, "query_id int, source string, chunk_id string, score double")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["ch_b", "ch_a"]
    assert got[0].component_scores == {"dense": 1.0, "sparse": 3.0} and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-9
    cands = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id int, index int, chunk_id string")
    scored = spark.createDataFrame([(1, 1, 5.0), (1, 7, 9.0), (1, 0, 5.0)], "query_id int, index int, score double")
    assert [r.chunk_id for r in fusion.normalised(cands, scored, 5).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("got,rel,k,recall,precision,mrr,ndcg", [
    (["d1", "d2", "d3"], ["d2"], 3, 1, 1 / 3, 0.5, 1 / math.log2(3)), (["d2", "d1", "d3"], ["d2"], 1, 1, 1, 1, 1), (["d1", "d3"], ["d2"], 2, 0, 0, 0, 0), (["d1"], [], 3, 1, 0, 0, 0), (["d2"], ["d2"], 0, 0, 0, 1, 0)])
def test_ir_metrics(spark, got, rel, k, recall, precision, mrr, ndcg):
    r, g = F.col("r"), F.col("g")
    row = spark.createDataFrame([(got, rel)], "r array<string>, g array<string>").select(metrics.recall_at(r, g, k), metrics.precision_at(r, g, k), metrics.reciprocal_rank(r, g), metrics.ndcg_at(r, g, k)).first()
    assert [round(x, 9) for x in row] == [round(x, 9) for x in (recall, precision, mrr, ndcg)]


def runs(spark, base, new):
    rows = [("base", i, "m", float(v)) for i, v in enumerate(base)] + [("new", i, "m", float(v)) for i, v in enumerate(new)]
    return spark.createDataFrame(rows, "run string, item_id int, metric string, value double")


@pytest.mark.parametrize("mode,base,new,floor,passed", [
    ("bootstrap", [0.8] * 10, [0.8] * 10, None, True), ("bootstrap", [0.9] * 10, [0.5] * 10, None, False), ("threshold", [0.9] * 5, [0.6] * 5, 0.7, False),
    ("threshold", [0.9] * 5, [0.8] * 5, 0.7, True), ("both", [0.9] * 8, [0.88] * 8, 0.9, False), ("both", [0.9] * 8, [0.8] * 8, 0.7, False), ("bootstrap", [0.9] * 3, [float("nan")] * 3, None, False)])
def test_gate(spark, mode, base, new, floor, passed):
    floors = None if floor is None else {"m": floor}
    assert metrics.gate(runs(spark, base, new), mode, floors=floors, resamples=50).first().passed == passed


def test_gate_refuses(spark):
    for scores, mode, floors in ((runs(spark, [1, 1], [1]), "bootstrap", None), (runs(spark, [], []), "bootstrap", None), (runs(spark, [1], [1]), "both", None), (runs(spark, [1], [1]), "threshold", {"other": 1.0})):
        with pytest.raises(ValueError):
            metrics.gate(scores, mode, floors=floors)


def test_answer_metrics(spark):
    df = spark.createDataFrame([([False, True],), ([True, True],), ([False],), ([],)], "f array<boolean>")
    assert [r[0] for r in df.select(metrics.context_precision(F.col("f"))).collect()] == [0.5, 1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(metrics.supported_share(F.transform("f", lambda x: F.struct(x.alias("supported"))))).collect()] == [0.5, 1.0, 0.0, 0.0]
    votes = spark.createDataFrame([(1, 0.2, "a"), (1, 0.9, "b"), (1, 0.5, "c"), (1, 0.6, "d"), (2, 0.1, "e")], "item int, score double, rationale string")
    assert sorted((r.item, r.score, r.rationale) for r in metrics.upper_median(votes, ["item"]).collect()) == [(1, 0.6, "d"), (2, 0.1, "e")]


def test_cache(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    entries = spark.createDataFrame([(1, "t", None, [], [1.0, 0.0], ["d1"])], "entry_id int, tenant_id string, collection_id string, tags array<string>, vector array<double>, doc_ids array<string>")
    stored = cache.stored(entries.withColumn("expires_at", now).limit(0), entries, now, 100)
    q = lambda t, c, tags, v: spark.createDataFrame([(1, t, c, tags, v)], "query_id int, tenant_id string, collection_id string, tags array<string>, query_vector array<double>")
    at = lambda s: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,{s})")
    hit = lambda *a, s=50: cache.lookup(q(*a), stored, at(s)).count()
    assert [hit("t", None, [], [1.0, 0.0]), hit("t", "", [], [2.0, 0.0]), hit("t", None, [], [0.0, 1.0]), hit("u", None, [], [1.0, 0.0]), hit("t", "c", [], [1.0, 0.0]), hit("t", None, ["x"], [1.0, 0.0]), hit("t", None, [], [1.0, 0.0], s=101)] == [1, 1, 0, 0, 0, 0, 0]
    changed = spark.createDataFrame([("t", "any", "d1")], "tenant_id string, collection_id string, doc_id string")
    assert cache.invalidated(stored, changed).count() == 0 and cache.invalidated(stored, changed.withColumn("tenant_id", F.lit("u"))).count() == 1


def test_costs_and_summary(spark):
    usage = spark.createDataFrame([("claude-haiku-4-5-20251001", 1000, 2000), ("nobody", 5, 5)], "model string, prompt_tokens int, completion_tokens int")
    assert [(r.cost_usd, r.known_model) for r in observe.priced(usage, observe.prices(spark)).orderBy(F.desc("cost_usd")).collect()] == [(0.00025 + 0.0025, True), (0.0, False)]
    runs_ = spark.createDataFrame([(100.0, 0.001), (200.0, 0.002), (None, None)], "latency_ms double, cost_usd double")
    r = observe.summary(runs_).first()
    assert (r.n, r["mean"], r["median"], r.p95, r.cost_total) == (3, 150.0, 150.0, 100.0, 0.003)
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert nan.agg(observe.nan_mean(F.col("v"))).first()[0] == 1.0 and math.isnan(nan.limit(1).agg(observe.nan_mean(F.col("v"))).first()[0])
