import pytest
from pyspark.sql import functions as F

from lakeseek.sources import store

CHUNK = "chunk_id string, tenant_id string, acl_tags array<string>, collection_id string, text string, embedding array<float>"


def chunks(spark, *rows):
    return spark.createDataFrame([(c, t, [], None, x, [1.0, 2.0]) for c, t, x in rows], CHUNK)


def test_tenants_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    store.replace_tenants(chunks(spark, ("a", "t", "1"), ("b", "../../evil", "2")), path)
    store.replace_tenants(chunks(spark, ("c", "t", "3")), path)
    assert sorted((r.chunk_id, r.tenant_id) for r in store.read_index(spark, path).collect()) == [("b", "../../evil"), ("c", "t")]
    one = store.read_index(spark, path, "t")
    assert [r.chunk_id for r in one.collect()] == ["c"] and "PartitionFilters: [isnotnull(tenant_key" in one._jdf.queryExecution().toString()
    assert not (tmp_path / "evil").exists()


def test_embeddings_are_checked(spark):
    good = chunks(spark, ("a", "t", "1"))
    assert store.checked(good, 2).count() == 1 and len(store.checked(good, 2).collect()) == 1
    for bad in (store.checked(good, 3), store.checked(good.withColumn("embedding", F.lit(None).cast("array<float>")), 2)):
        with pytest.raises(Exception, match="embedding"):
            bad.collect()


def test_payloads_and_counts(spark, tmp_path):
    rows = chunks(spark, ("a", "t", "1"), ("b", "u", "2"))
    back = store.from_payload(store.payload(rows), "tenant_id string, acl_tags array<string>, collection_id string, text string, acl_open boolean")
    assert sorted((r.chunk_id, r.tenant_id, r.text, r.acl_open, list(r.embedding)) for r in back.collect()) == [("a", "t", "1", True, [1.0, 2.0]), ("b", "u", "2", True, [1.0, 2.0])]
    caller = spark.createDataFrame([("t", [], None)], "tenant_id string, caller_tags array<string>, query_collection string")
    assert (store.count_visible(rows), store.count_visible(rows, caller)) == (2, 1)
    store.export_golden(spark.createDataFrame([("q", "a", "t")], "question string, expected_output string, tenant_id string"), str(tmp_path / "g"))
    assert len(spark.read.json(str(tmp_path / "g")).first().id) == 16
