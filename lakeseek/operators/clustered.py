"""A vector index in cells: k-means cells, rows laid out by tenant and cell, exact scores within the cells looked into.

Centres are trained on a sample of bounded size (SAMPLE rows for each centre, a documented parameter), by rounds in which
Spark assigns the rows and averages them; every row is indexed. A question looks into its nearest cells alone, whose folders
are the only ones opened; all visible rows there are scored by their own vectors, where they lie. (A cut by coded
residuals before that lost rows: copies of one vector share one code, so many copies filled the places of nearer rows.)

A question whose tenant has no more rows than one look would give is answered exactly, by reading all its cells.
Rows without length are their own kind: their cosine is 0, so they lie in cell 0 and are met by any question of it only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions import vector
from lakeseek.operators import local
from lakeseek.operators.acl import tenant_key
from lakeseek.operators.dense import blocks, matrix, scorer
from lakeseek.sources.snapshots import Log
from lakeseek.sources.staging import staged

#: Rows of the training sample per centre, rounds of training.
SAMPLE, ROUNDS = 256, 8
#: Cells looked into.
PROBES = 8


@dataclass
class Index:
    """Rows under ``path``/rows by tenant digest and cell; centres are a small list of vectors."""

    spark: SparkSession
    path: str
    version: int
    key: str
    centres: list[list[float]]
    schema: str
    place: str

    def rows(self) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/{self.place}")


def unit(v: Column, norm: Column) -> Column:
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def nearest(v: Column, centres: Column, n: int) -> Column:
    """The ``n`` centres of greatest inner product with ``v``: array of struct (score, cell), best first."""
    told = F.transform(centres, lambda c, i: F.struct(F.round(vector.dot(v, c), 12).alias("score"), (-i).alias("o")))
    return F.transform(F.slice(F.sort_array(told, asc=False), 1, n), lambda s: F.struct(s["score"].alias("score"), (-s["o"]).alias("cell")))


def _literal(centres: list[list[float]]) -> Column:
    return F.from_json(F.lit(json.dumps(centres)), "array<array<double>>")


def train(vectors: DataFrame, cells: int, rounds: int = ROUNDS, seed: int = 0) -> list[list[float]]:
    """Centres of unit vectors (column u), at most ``cells``: rounds of assigning and averaging on a sample of SAMPLE rows per centre.

    The sample is the rows of least digest, so that it is the same at each run. Only sums per centre and dimension reach the driver.
    """
    sample = staged(vectors.where("u is not null").withColumn("o", F.xxhash64(F.lit(seed), "u")).orderBy("o").limit(SAMPLE * cells))
    centres = [r["u"] for r in sample.select("u").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "u")).limit(cells).collect()]
    for _ in range(rounds if centres else 0):
        assigned = sample.select("u", nearest(F.col("u"), _literal(centres), 1)[0]["cell"].alias("cell"))
        sums = assigned.select("cell", F.posexplode_outer("u").alias("i", "x")).groupBy("cell", "i").agg(F.avg("x").alias("x")).collect()
        fresh: dict[int, dict[int, float]] = {}
        for r in sums:
            fresh.setdefault(r["cell"], {})[r["i"]] = r["x"]
        # a centre that nobody chose stays where it is
        centres = [[fresh[c][i] for i in range(len(old))] if c in fresh else old for c, old in enumerate(centres)]
    return centres


def _flat(v: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors with a length, by size."""
    out, sizes = [], pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    for size in set(sizes.tolist()) - {0}:
        rows, ok = matrix(v, size)
        norm = np.linalg.norm(rows, axis=1)
        at = np.flatnonzero(ok & (norm > 0))
        out.append((at, rows[at] / norm[at, None]))
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def units(v: pa.Array) -> pa.Array:
    """Vectors of length 1; null for those without a length."""
    out: list = [None] * len(v)
    for at, rows in _flat(v):
        for i, row in zip(at, rows, strict=True):
            out[i] = row
    return pa.array(out, pa.list_(pa.float64()))


def cell_of(v: Column, centres: list[list[float]]) -> Column:
    """The centre of greatest inner product with the unit vector, the first of equal ones; 0 for a vector without a length."""

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int32)
        for at, rows in _flat(vectors):
            held = [c for c, x in enumerate(centres) if len(x) == rows.shape[1]]
            if held:
                out[at] = np.array(held)[np.round(rows @ np.array([centres[c] for c in held]).T, 12).argmax(axis=1)]
        return pa.array(out)

    return cell(v)


def build(rows: DataFrame, path: str, run: str, cells: int = 64, key: str = "vec_id") -> Index:
    """Index rows (``key``, embedding, tenant_id, acl_tags, collection_id, ...) as a new version under ``path``."""
    spark = rows.sparkSession
    log = Log(spark, path)
    done = log.run(run)
    if done is None:
        base = log.state()
        local.bounded(spark)
        centres = train(rows.select(units(F.col("embedding").cast("array<double>")).alias("u")), cells)
        laid = rows.withColumn("cell", cell_of(F.col("embedding").cast("array<double>"), centres)).withColumn("tenant_key", tenant_key(F.col("tenant_id")))
        place = f"data/rows-{uuid.uuid4().hex}"
        # each task writes what it holds into the folders; the table is neither staged nor shuffled
        laid.write.option("compression", "zstd").partitionBy("tenant_key", "cell").parquet(f"{path}/{place}")
        order = [c for c in laid.schema.fields if c.name not in ("tenant_key", "cell")] + [laid.schema["tenant_key"], laid.schema["cell"]]
        schema = json.dumps({"type": "struct", "fields": [f.jsonValue() for f in order]})
        done = log.commit(base["version"], run, {"centres": centres, "schema": schema, "key": key, "tables": {"rows": {"place": place}}})
    return opened(spark, path, done["version"])


def opened(spark: SparkSession, path: str, version: int | None = None) -> Index:
    state = Log(spark, path).state(version)
    return Index(spark, path, state["version"], state["key"], state["centres"], state["schema"], state["tables"]["rows"]["place"])


def looked_into(queries: DataFrame, index: Index, probes: int = PROBES) -> DataFrame:
    """``queries`` with tenant_key, query_norm, query_unit, and a row for each cell looked into: cell and score, the centre's part of the cosine."""
    normed = queries.withColumn("query_norm", vector.norm(F.col("query_vector"))).withColumn("query_unit", unit(F.col("query_vector"), F.col("query_norm"))).withColumn("tenant_key", tenant_key(F.col("tenant_id")))
    cells = nearest(F.col("query_unit"), _literal(index.centres or [[0.0]]), probes)
    return normed.withColumn("p", F.explode_outer(cells)).select(*normed.columns, F.col("p.score").alias("centre_score"), F.col("p.cell").alias("cell"))


def _rows_of(index: Index, probed: DataFrame) -> DataFrame:
    """The index's rows in the folders that the questions look into."""
    folders = probed.select("tenant_key", "cell").distinct().groupBy("tenant_key").agg(F.collect_set("cell").alias("cells")).collect()  # at most one row per tenant asked
    wanted = F.lit(False)
    for r in folders:
        wanted = wanted | ((F.col("tenant_key") == r["tenant_key"]) & F.col("cell").isin(r["cells"]))
    return index.rows().where(wanted)


def top_k(queries: DataFrame, index: Index, k: int = 20, probes: int = PROBES, rescored: int | None = None) -> DataFrame:
    """query_id, key, score, rank: the nearest visible rows in the cells of each question, as dense.top_k scores them.

    The access rule runs before any ranking, and a task keeps and sends on k rows per question. All rows of the cells are
    scored exactly, so ``rescored``, once the length of a list cut by codes, changes nothing.
    """
    key, parts = index.key, []
    stored = index.rows()
    wanted = queries.select("query_id", *local.RIGHTS, "query_vector")
    schema = T.StructType([wanted.schema["query_id"], T.StructField("score", T.DoubleType()), stored.schema[key]])
    for block in blocks(wanted):
        probed = staged(looked_into(block, index, probes).select("query_id", "tenant_key", "cell"))
        asked = block.collect()
        into: dict = {}
        for r in probed.collect():  # at most ``probes`` rows a question
            into.setdefault(r["query_id"], set()).add(r["cell"])
        member = np.array([[c in into[r["query_id"]] for c in range(max(len(index.centres), 1))] for r in asked], bool).reshape(len(asked), -1)
        exact = scorer([r["query_vector"] for r in asked], "embedding")

        def score(batch: pa.RecordBatch, member=member, exact=exact) -> np.ndarray:
            return np.where(member[:, batch.column("cell").to_numpy()], exact(batch), np.nan)  # no number: not met

        parts.append(local.best(_rows_of(index, probed), asked, score, ["embedding", "cell"], [key], k, schema))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.select("query_id", key, "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """Share of the exact lists' rows that were found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
