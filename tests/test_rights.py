import contextlib
import io

from pyspark.sql import functions as F

from lakeseek.operators import bm25, cache, chunking, incremental, registry

INDEX = "tenant_id string, chunk_id string, title string, acl_tags array<string>, acl_open boolean"
UPDATES = "tenant_id string, chunk_id string, caller_tags array<string>, title string, acl_tags array<string>"


def test_a_caller_patches_only_what_it_may_touch(spark):
    index = spark.createDataFrame([("t", "secret", "old", ["board"], False), ("t", "open", "old", [], True), ("u", "secret", "old", ["board"], False)], INDEX)
    updates = spark.createDataFrame([
        ("t", "secret", ["intern"], "taken", []), ("t", "secret", ["board"], "new", ["board", "staff"]),
        ("t", "open", ["intern"], "a", []), ("t", "open", [], "b", []), ("u", "secret", ["intern"], "taken", []),
    ], UPDATES)
    got = sorted(tuple(r) for r in registry.patched_chunks(index, updates).collect())
    assert got == [("t", "open", "b", [], True), ("t", "secret", "new", ["board", "staff"], False), ("u", "secret", "old", ["board"], False)]
    later = updates.where("chunk_id = 'open'").withColumn("seq", F.when(F.col("title") == "a", 2).otherwise(1))
    assert [r.title for r in registry.patched_chunks(index, later).where("chunk_id = 'open'").collect()] == ["a"]


def test_tag_keys_are_distinct(spark):
    tags = [["a|b"], ["a", "b"], ["b", "a", "a"], [], None, [""], ['a","b']]
    keys = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t array<string>").withColumn("k", cache.tags_key(F.col("t"))).orderBy("i").collect()]
    assert keys[1] == keys[2] and keys[3] == keys[4]
    assert len({keys[0], keys[1], keys[3], keys[5], keys[6]}) == 5


def test_repeated_keys_in_a_batch_leave_one_row(spark):
    table = spark.createDataFrame([(1, "x")], "k int, v string")
    more = spark.createDataFrame([(1, "y"), (2, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, incremental.upserted(table, more, ["k"]).collect())) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, incremental.inserted(table, more, ["k"]).collect())) == [(1, "x"), (2, "b")]


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_no_text_is_split_again_by_an_inferred_filter(spark):
    docs = spark.createDataFrame([(1, "a b", "t", ["x"], None, "s", "n")], "doc_id long, text string, tenant_id string, acl_tags array<string>, collection_id string, source string, title string")
    chunks = docs.withColumn("chunk_id", F.lit("1")).withColumn("seq", F.col("doc_id"))
    for df in (bm25.postings(chunks), chunking.chunk(docs)):
        assert not [line for line in _plan(df).splitlines() if "Filter" in line.split("(")[0] and "split(" in line]


def test_long_documents_are_counted_in_linear_time(spark):
    docs = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("tenant_id"), F.expr("concat_ws(' ', transform(sequence(1, 6000), i -> concat('w', pmod(i * (id + 3), 997))))").alias("text"))
    df = bm25.document_frequency(bm25.postings(docs))
    assert df.count() == 997
