import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lakeseek.functions.vector import tokens
from lakeseek.operators import bm25, dense, inverted
from lakeseek.sources.staging import staged

CHUNK = "tenant_id string, chunk_id string, acl_tags array<string>, collection_id string, seq long, text string"
ASKED = "query_id long, question string, tenant_id string, caller_tags array<string>, query_collection string"


def shuffled(spark, job, what="shuffleWriteRecords"):
    """Result of ``job``, and the rows (or bytes) that its stages wrote to shuffles."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))

    before = written()
    out = job()
    return out, written() - before


def plain(chunks, asked, k):
    """Rankings by all pairs in plain Python."""
    out = set()
    for qid, question, tenant, tags, scope in asked:
        mine = [(c, c[5].lower().split()) for c in chunks if c[0] == tenant]
        avgdl, df = sum(len(w) for _, w in mine) / max(len(mine), 1), Counter(t for _, w in mine for t in set(w))
        raw = {t: math.log(len(mine) - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
        low = 0.25 * sum(raw.values()) / max(len(raw), 1)
        rows = []
        for c, w in mine:
            if (c[2] and not set(c[2]) & set(tags)) or (scope is not None and c[3] != scope):
                continue
            tf = Counter(w)
            s = sum(n * (raw[t] if raw[t] >= 0 else low) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t, n in Counter(question.lower().split()).items() if tf[t])
            rows.append((-round(s, 9) + 0.0, c[4], c[1]))
        out |= {(qid, i + 1, c, round(-s + 0.0, 7)) for i, (s, _, c) in enumerate(sorted(rows)[:k])}
    return out


@pytest.mark.parametrize("stored", [False, True])
def test_no_pairs_are_shuffled(spark, stored):
    rng = random.Random(1)
    words = ["all", "All", *[f"w{i}" for i in range(60)]]
    chunks = [(rng.choice("ttu"), f"c{i:05d}", rng.choice([[], [], ["board"]]), rng.choice(["a", "b", None]), i // 2, " ".join(["all"] * (i % 7 > 0) + rng.choices(words, k=rng.randint(0, 12)))) for i in range(3000)]
    asked = [(i, "all " + " ".join(rng.choices(words, k=5)), rng.choice("tu"), rng.choice([[], ["board"]]), rng.choice(["a", None, None])) for i in range(40)]
    rows = staged(spark.createDataFrame(chunks, CHUNK).repartition(3))
    source = bm25.build(rows) if stored else rows
    got, n = shuffled(spark, lambda: bm25.top_k(spark.createDataFrame(asked, ASKED), source, 5).collect())
    assert {(r.query_id, r["rank"], r.chunk_id, round(r.score, 7) + 0.0) for r in got} == plain(chunks, asked, 5)
    assert n < 6000, n  # 40 questions see some 40,000 pairs of a question and a chunk that holds their word


def test_dense_ties_and_missing_vectors(spark):
    schema = "vec_id long, embedding array<double>, tenant_id string, acl_tags array<string>, collection_id string"
    rows = [(i, [1.0, float(i // 50)], "t", [] if i % 2 else ["x"], None) for i in range(400)] + [(900, [0.0, 0.0], "t", [], None), (901, None, "t", [], None)]
    asked = spark.createDataFrame([(1, [0.0, 2.0], "t", [], None), (2, [0.0, 0.0], "t", ["x"], None)], "query_id long, query_vector array<double>, tenant_id string, caller_tags array<string>, query_collection string")
    got = sorted(map(tuple, dense.top_k(asked, spark.createDataFrame(rows, schema).repartition(4), 3).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(1, 1, 351, round(7 / math.sqrt(50), 9)), (1, 2, 353, round(7 / math.sqrt(50), 9)), (1, 3, 355, round(7 / math.sqrt(50), 9)), (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0)]
    few = spark.createDataFrame(rows[-2:], schema)
    assert sorted((r.query_id, r.vec_id, r.score) for r in dense.top_k(asked, few, 3).collect()) == [(1, 900, 0.0), (1, 901, None), (2, 900, 0.0), (2, 901, None)]


def test_arrow_and_spark_split_alike(spark):
    texts = ["".join(chr(c) + "x" for c in range(1, 256)), " a  b ", "", " a b\u0085c", "é　ß İ"]
    want = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(tokens(F.col("text")).alias("t")).collect()]
    lower = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(F.lower("text").alias("t")).collect()]
    assert [[w for w in x if w] for x in pc.ascii_split_whitespace(pa.array(lower)).to_pylist()] == want


def test_building_an_index_shuffles_no_postings(spark, tmp_path):
    rng = random.Random(2)
    chunks = [("t", f"c{i:04d}", [], None, i, " ".join(["all", *rng.choices([f"w{j}" for j in range(200)], k=30)])) for i in range(600)]
    rows = staged(spark.createDataFrame(chunks, CHUNK))
    index, n = shuffled(spark, lambda: inverted.added(spark, str(tmp_path / "i"), rows, "one"))
    assert n < 2000, n  # some 17,000 postings
    asked = [(i, f"all w{i} w{i + 1}", "t", [], None) for i in range(20)]
    got = inverted.top_k(spark.createDataFrame(asked, ASKED), index, 5).collect()
    assert {(r.query_id, r["rank"], r.chunk_id, round(r.score, 7) + 0.0) for r in got} == plain(chunks, asked, 5)
    assert index.table("blocks").selectExpr("max(size(postings))").first()[0] <= inverted.BLOCK
    told = index.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("term = 'all'").first().df
    assert told == 600


def test_prefixes_without_texts_beside_their_keys(spark):
    from lakeseek.operators import chunking

    rng = random.Random(4)
    docs = staged(spark.createDataFrame([("t", i, " ".join(rng.choices([f"w{j}" for j in range(5000)], k=[0, 20, 1500][i % 3])) if i != 7 else None) for i in range(60)], "tenant_id string, doc_id long, text string"))
    count = lambda doc, text: F.concat(F.lit(" doc "), F.length(doc).cast("string"), F.length(text).cast("string"))
    keys = staged(chunking.keys_of(docs))
    half = keys.where("ordinal % 2 = 0").select("prefix_key", F.concat(F.lit("p"), "ordinal").alias("prefix"))
    cache = staged(half.unionByName(half))  # a key that is held twice gives no row twice
    want = chunking.prefixed(chunking.chunk(docs), docs, cache.distinct(), count)
    columns = ["tenant_id", "doc_id", "ordinal", "chunk_id", "text", "prefix_key", "contextual_prefix"]
    before = sorted(map(tuple, want.select(columns).collect()))
    got, n = shuffled(spark, lambda: sorted(map(tuple, chunking.prefixed_of(docs, cache, count, keys=keys).select(columns).collect())), "shuffleWriteBytes")
    assert got == before and len(got) > 400
    assert n < 2 * docs.selectExpr("sum(length(text))").first()[0], n
