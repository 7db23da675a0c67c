import pytest

from lakeseek.operators import acl, dense
from pyspark.sql import functions as F

CHUNKS = [("pub::0", "public", [], "c"), ("a::0", "tenant_a", [], "c"), ("b::0", "tenant_b", [], "c"), ("a::sec", "tenant_a", ["board"], "d")]
CHUNK = "chunk_id string, tenant_id string, acl_tags array<string>, collection_id string"
QUERY = "query_id int, tenant_id string, caller_tags array<string>, query_collection string"


@pytest.mark.parametrize(
    "tags,collection,want",
    [([], None, {"a::0"}), (["board"], None, {"a::0", "a::sec"}), (["other"], None, {"a::0"}), (["board"], "d", {"a::sec"}), ([], "d", set())],
)
def test_visibility(spark, tags, collection, want):
    q = spark.createDataFrame([(1, "tenant_a", tags, collection)], QUERY)
    assert {r.chunk_id for r in acl.visible(q, spark.createDataFrame(CHUNKS, CHUNK)).collect()} == want


def test_best_match_of_another_tenant_never_appears(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0], "b", [], "x"), (2, [0.5, 0.5], "a", [], "x"), (3, [0.0, 0.0], "a", [], "x"), (4, [1.0, 0.0], "a", ["board"], "x")],
                                 "vec_id long, embedding array<double>, tenant_id string, acl_tags array<string>, collection_id string")
    q = spark.createDataFrame([(9, "a", [], None, [1.0, 0.0])], QUERY + ", query_vector array<double>")
    got = [(r.vec_id, round(r.score, 6), r["rank"]) for r in dense.top_k(q, vecs, 5).orderBy("rank").collect()]
    assert got == [(2, 0.707107, 1), (3, 0.0, 2)]


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i % 5), 1.0], "a", [], "x") for i in range(30)], "vec_id long, embedding array<double>, tenant_id string, acl_tags array<string>, collection_id string")
    q = spark.createDataFrame([(i, "a", [], None, [float(i), 1.0]) for i in range(11)], QUERY + ", query_vector array<double>")
    whole = sorted(map(tuple, dense.top_k(q, vecs, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, dense.top_k(q, vecs, 3).collect())) == whole


def test_predicates(spark):
    df = spark.createDataFrame([("a", "x" * 129, ""), (" ", "ok", "q"), ("b", "a\x01", "q" * 8001)], "t string, c string, q string")
    rows = df.select(acl.valid_tenant(F.col("t")), acl.valid_collection(F.col("c")), acl.valid_question(F.col("q"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (False, True, True), (True, False, False)]
    tags = spark.createDataFrame([(["b", "a"], ["a", "b"]), (["b"], []), (["b"], None)], "t array<string>, l array<string>")
    assert [r[0] for r in tags.select(acl.narrowed(F.col("t"), F.col("l"))).collect()] == [["b", "a"], [], ["b"]]
    assert spark.range(1).select(acl.tenant_key(F.lit("../../evil"))).first()[0].isalnum()
