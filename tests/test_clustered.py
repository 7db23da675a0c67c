import random

from pyspark.sql import functions as F

from lakeseek.operators import clustered, dense
from lakeseek.sources import tables

ROWS = "vec_id long, embedding array<double>, tenant_id string, acl_tags array<string>, collection_id string"
ASKED = "query_id long, query_vector array<double>, tenant_id string, caller_tags array<string>, query_collection string"


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_recall_and_cells_opened_on_the_table(spark, tmp_path):
    vecs = tables.vectors(spark, "/root/testdata/sf0.1").cache()
    asked = tables.vector_queries(vecs)
    index = clustered.build(vecs, str(tmp_path / "v"), "run", cells=16)
    exact = dense.top_k(asked, vecs)
    share = clustered.recall(clustered.top_k(asked, index, probes=12), exact)
    assert share >= 0.9, share  # these vectors have hardly any clusters, so three of four cells are needed
    assert index.rows().count() == vecs.count()
    probed = clustered.looked_into(asked.limit(1), index, 2)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else the plan's text cuts its filters short
    scan = clustered._rows_of(index, probed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "cell#" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    met = clustered._rows_of(index, probed)
    assert met.select("tenant_key", "cell").distinct().count() <= 2 and met.select("tenant_id").distinct().count() == 1


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = random.Random(3)
    homes = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in homes[i % 40]], "tu"[i % 3 == 0], [] if i % 5 else ["board"], None) for i in range(4000)]
    vecs = spark.createDataFrame(rows, ROWS).cache()
    asked = spark.createDataFrame([(i, [x + rng.gauss(0, 0.25) for x in rng.choice(homes)], "t", [], None) for i in range(40)], ASKED)
    index = clustered.build(vecs, str(tmp_path / "v"), "run", cells=32)
    assert clustered.recall(clustered.top_k(asked, index, probes=4), dense.top_k(asked, vecs)) >= 0.9


def test_all_cells_give_the_exact_lists(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], rng.choice("tu"), rng.choice([[], ["board"]]), rng.choice(["a", None])) for i in range(300)]
    rows += [(900, [0.0] * 5, "t", [], None), (901, rows[0][1], rows[0][2], [], None)]
    vecs = spark.createDataFrame(rows, ROWS)
    asked = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)], rng.choice("tu"), rng.choice([[], ["board"]]), rng.choice(["a", None])) for i in range(15)] + [(50, [0.0] * 5, "t", [], None)], ASKED)
    index = clustered.build(vecs, str(tmp_path / "v"), "run", cells=8)
    assert rows_of(clustered.top_k(asked, index, 9, probes=8, rescored=10**4)) == rows_of(dense.top_k(asked, vecs, 9))
    # codes alone rank well enough that few rows need their own vectors
    some = clustered.recall(clustered.top_k(asked.where("query_id < 50"), index, 9, probes=8, rescored=2), dense.top_k(asked.where("query_id < 50"), vecs, 9))
    assert some >= 0.95, some


def test_versions_and_small_tables(spark, tmp_path):
    path = str(tmp_path / "v")
    one = spark.createDataFrame([(1, [1.0, 0.0], "t", [], None)], ROWS)
    first = clustered.build(one, path, "a")
    assert clustered.build(one.limit(0), path, "a").version == first.version == 1  # the run was committed
    none = clustered.build(one.limit(0), path, "b")
    asked = spark.createDataFrame([(7, [0.6, 0.8], "t", [], None)], ASKED)
    assert clustered.top_k(asked, none).count() == 0
    assert rows_of(clustered.top_k(asked, clustered.opened(spark, path, 1))) == [(7, 1, 1, 0.6)]


def test_nearest_breaks_ties_by_number(spark):
    held = F.from_json(F.lit("[[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]"), "array<array<double>>")
    got = spark.range(1).select(clustered.nearest(F.array(F.lit(1.0), F.lit(0.5)), held, 2).alias("n")).first().n
    assert [(g.score, g.cell) for g in got] == [(1.0, 0), (1.0, 1)]


def test_many_copies_push_no_row_out(spark, tmp_path):
    """Sixty copies of each vector: their equal codes filled the list of rows that were scored, and the least ids were lost."""
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, base[i % 60], "t", [], None) for i in range(3600)]
    vecs = spark.createDataFrame(rows, ROWS)
    asked = spark.createDataFrame([(i, [x + rng.gauss(0, 0.02) for x in base[i]], "t", [], None) for i in range(12)], ASKED)
    near = spark.createDataFrame([(10**6 + i, [x + rng.gauss(0, 0.01) for x in base[i % 12]], "t", [], None) for i in range(2400)], ROWS)
    index = clustered.build(vecs.unionByName(near), str(tmp_path / "v"), "run", cells=4)
    assert rows_of(clustered.top_k(asked, index, probes=4)) == rows_of(dense.top_k(asked, vecs.unionByName(near)))
