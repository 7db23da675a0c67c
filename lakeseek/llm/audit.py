"""Filter interaction audit: what each filter removes alone, after others, and its Shapley share.

Per part of the corpus the removals of all 32 coalitions of the five filters are tabulated once, from counts per set of
failed filters. Everything else follows from these tables:

* a step's counts are differences of the coalitions before and after it, in any of the 120 orders;
* Shapley shares are the constrained least squares fit of additive shares to the coalitions' removals: weighted by the
  Shapley kernel, with shares that sum to what all filters remove together. The normal equations have the same matrix
  for all parts; it is inverted once in fractions, and each part's right-hand side is a sum of counts, so shares are
  exact integers once multiplied by the number of orders.

Whether a text was seen before is decided without bringing copies together: the least id of each text is found by a
partial minimum, and only the row of that very id is told apart.

Defined cases: a null text is empty (it fails A, and E if a smaller id has an empty text); a null source is the part
``''``; a null id has no smaller one and precedes none; repeated rows count again, and those of one id and text are no
copies of each other; labels of an id count once, by their greatest value; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import read_table, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits A to D of the filters that a text fails."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (the filters that a document fails), good, toxic, n: counts of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("mask"))
    once = written(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))  # about 80 bytes a row: texts are read once
    firsts = once.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    told = once.join(firsts, ["doc_id", "digest"], "left")
    late = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    quality = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    joined = told.select("doc_id", "part", (F.col("mask") + late).alias("mask"), "n").join(quality, "doc_id", "left")
    return joined.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def coalitions(counts: DataFrame) -> DataFrame:
    """part, total, and v, v_good, v_toxic: arrays of what each of the 32 coalitions (by its bits) removes of all, good and toxic documents."""

    def table(worth: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, worth).otherwise(F.lit(0).cast("long"))) for s in range(ALL + 1)])

    return counts.groupBy("part").agg(F.sum("n").alias("total"), table(F.col("n")).alias("v"), table(F.col("n") * F.col("good")).alias("v_good"), table(F.col("n") * F.col("toxic")).alias("v_toxic"))


def inverse(a: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination in fractions."""
    n = len(a)
    m = [[Fraction(x) for x in row] + [Fraction(int(i == j)) for j in range(n)] for i, row in enumerate(a)]
    for i in range(n):
        k = next(k for k in range(i, n) if m[k][i] != 0)
        m[i], m[k] = m[k], m[i]
        m[i] = [x / m[i][i] for x in m[i]]
        for k in range(n):
            if k != i and m[k][i] != 0:
                m[k] = [x - m[k][i] * y for x, y in zip(m[k], m[i])]
    return [row[n:] for row in m]


def kernel(size: int, players: int) -> Fraction:
    """Weight of a coalition in the fit; none and all of the players are held exactly, by the constraint."""
    return Fraction(players - 1, comb(players, size) * size * (players - size)) if 0 < size < players else Fraction(0)


def shares(v: Column, players: int = len(FILTERS)) -> Column:
    """Array of the players' Shapley values of the game ``v`` (removals by coalition), times the number of orders, as exact integers.

    Minimise the kernel-weighted squares of v(S) - sum of the shares in S, subject to shares that sum to v(all). With A
    the weighted counts of coalitions that hold i and j, and b the weighted sums of v over coalitions that hold i:

        A x + y = b,  sum of x = v(all)
    """
    sets = range(1, (1 << players) - 1)
    weight = {s: kernel(s.bit_count(), players) for s in sets}
    a = [[sum((weight[s] for s in sets if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(players)] + [Fraction(1)] for i in range(players)]
    solved = inverse([*a, [Fraction(1)] * players + [Fraction(0)]])
    scale = lcm(*(w.denominator for w in weight.values()))  # right-hand sides in integers
    right = [sum((v[s] * int(weight[s] * scale) for s in sets if s >> i & 1), F.lit(0).cast("long")) for i in range(players)]
    right.append(v[(1 << players) - 1] * scale)
    common = lcm(*(x.denominator for row in solved for x in row))
    out = []
    for i in range(players):
        # times the number of orders a share is a whole number, so the division leaves no rest
        total = sum((right[j] * int(solved[i][j] * common) for j in range(players + 1)), F.lit(0).cast("long")) * factorial(players)
        out.append(F.call_function("div", total, F.lit(scale * common).cast("long")))
    return F.array(*out)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    tables = coalitions(failures(docs, labels)).withColumn("shares", shares(F.col("v")))
    # a coalition and the filter that comes next: 80 differences per part, whatever the number of orders
    pairs = [(before, f, 1 << f) for before in range(ALL + 1) for f in range(len(FILTERS)) if not before >> f & 1]
    at = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(f).alias("f"), F.lit(before + bit).alias("after"), F.lit(bit).alias("bit")) for before, f, bit in pairs])
    each = tables.select("*", F.explode_outer(at).alias("at")).select(*tables.columns, "at.*")

    def change(name: str) -> Column:
        return F.get(name, F.col("after")) - F.get(name, F.col("before"))

    steps = each.select(
        "part", "before", "f", (F.col("total") - F.get("v", F.col("after"))).alias("kept"), change("v").alias("removed"), (F.get("v", F.col("bit")) - change("v")).alias("redundant"),
        (F.get("v", F.lit(ALL)) - F.get("v", F.lit(ALL) - F.col("bit"))).alias("unique_fails"), change("v_good").alias("good_lost"), change("v_toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"),
    )
    orders = [("".join(FILTERS[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    # 600 rows: a fixed table of the orders
    plan = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, before int, f int"))
    return steps.join(plan, ["before", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _oracle() -> str:
    """Every order is walked by its filters' bits, and shares are averaged over all orders: nothing of the fit is used."""
    fails = [
        "len(w) < 200", "100 * len(list_distinct(w)) < 50 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)", "regexp_matches(t, '[#$%&*|]')",
        "EXISTS (SELECT 1 FROM least_ids l WHERE l.t = d.t AND l.least < d.doc_id)",
    ]
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
least_ids AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
q AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {' + '.join(f'CASE WHEN {f} THEN {1 << i} ELSE 0 END' for i, f in enumerate(fails))} AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN q USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
orders(filter_order) AS (VALUES {orders}),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f FROM orders, range(1, 6) r(step)),
bits AS (SELECT s.filter_order, s.step, s.f, (1 << (ascii(s.f) - 65))::INT AS bit, coalesce((SELECT sum(1 << (ascii(substr(s.filter_order, k::INT, 1)) - 65)) FROM range(1, 6) r(k) WHERE k < s.step), 0)::INT AS before FROM steps s),
x AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, bits GROUP BY ALL),
s AS (SELECT part, f, sum(removed)::BIGINT AS shapley FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM x JOIN s USING (part, f)"""


ORACLE = _oracle()
