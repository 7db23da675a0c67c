import random
from fractions import Fraction
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from lakeseek.llm import audit

DOCS = "doc_id long, text string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, n long"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """Every order walked document by document."""
    least, good, toxic, parts = {}, set(), set(), {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, q, x, _ in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    for d, text, source, *_ in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and least[text] < d,
        }
        parts.setdefault(source or "", []).append((d, fails))
    out = set()
    for part, rows in parts.items():
        walked, totals = [], dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(p):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                totals[f] += len(gone)
                walked.append(("".join(p), k + 1, f, len(left), len(gone), sum(r[1][f] for r in rows) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out |= {(part, o, s, *rest, totals[f]) for o, s, f, *rest in walked}
    return out


def sample():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(words[: rng.choice([40, 300])]) for _ in range(rng.choice([3, 150, 199, 200, 260])))
        text += rng.choice(["", " #", " |x", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAA"])
        docs.append((i, text, rng.choice(["a", "b", None, ""]), "clash", 1))
    docs += [(200 + i, docs[i % 5][1], "b", "clash", 1) for i in range(15)] + [(3, docs[3][1], "a", "x", 0)] * 2
    docs += [(None, docs[0][1], "a", "x", 0), (None, "only null", None, "x", 0), (300, None, "c", "x", 0), (301, "", "c", "x", 0), (302, " \n\t", "c", "x", 0), (303, "É ü 🙂 " * 400, "c", "x", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), 1) for i in range(0, 320, 2)] + [(4, 1, 1, 1), (4, 0, 0, 1), (None, 1, 1, 1)]
    return docs, labels


def test_equals_plain_walks(spark):
    docs, labels = sample()
    got = audit.audited(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == plain(docs, labels)


def test_sql_gives_the_same(spark, tmp_path):
    docs, labels = sample()
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    d.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    q.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}).to_parquet(tmp_path / "labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert {tuple(r) for r in con.sql(audit.ORACLE).fetchall()} == plain(docs, labels)


def test_shares_of_any_game(spark):
    """The fit's solution equals the mean over all orders, also for games in which removals interact."""
    rng = random.Random(8)
    for players in (2, 3, 5):
        v = [0] + [rng.randint(0, 10**9) for _ in range((1 << players) - 1)]
        want = []
        for i in range(players):
            total = 0
            for p in permutations(range(players)):
                before = sum(1 << j for j in p[: p.index(i)])
                total += v[before | 1 << i] - v[before]
            want.append(total)
        assert spark.range(1).select(audit.shares(F.lit(v).cast("array<long>"), players)).first()[0] == want


def test_inverse():
    a = [[Fraction(2), Fraction(1)], [Fraction(1), Fraction(0)]]
    assert audit.inverse(a) == [[0, 1], [1, -2]]


def test_empty(spark):
    assert audit.audited(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    docs, _ = sample()
    assert audit.audited(spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame([], LABELS)).agg(F.sum("good_lost")).first()[0] == 0
