import hashlib
import random
import re

from lakeseek.llm import boosting, pii


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def slow(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


CASES = [
    None, "", "no data here", "é🙂 a.b@c.de, x@y.z_q@r.st and @b.c a@b a.b@.c", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.255 9.9.9", "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796",
    "+1 (988) 555-2485 +12 +1-2-3-4-5-6-7-8 +123456789012345678 ++12345678", "4041894974608795 4337166598464399", "1 " * 30_000, "1.1" * 20_000, "a@b" + ".c" * 20_000, "x" * 100_000 + "@", "+1" + " " * 20_000 + "2",
    "call 555 123 4567 or mail me (at) home (dot) org", "+1 (988) 555-2485 4041894974608795 10.20.30.40 me@x.org " * 300,
]


def test_cases(spark):
    rows = [(i, t, i, "b", "r") for i, t in enumerate(CASES)] + [(None, CASES[3], 0, "b", "r"), (3, CASES[3], 0, "b", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, body string, row string")
    got = pii.with_spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(pii.KINDS[s.kind], s.start, s.end) for s in r.base]
        assert base == slow(r.row.text)
        assert set(base) <= {(pii.KINDS[s.kind], s.start, s.end) for s in r.spans}
    kept = pii.redacted(df)
    assert kept.columns == df.columns
    by = {r.doc_id: r.text for r in kept.collect()}
    assert by[0] is None and by[2] == CASES[2] and by[6].startswith("[PHONE] +12 ")
    assert pii.with_spans(df.limit(0)).count() == 0


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = pii.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    extra = 0
    for r in got:
        want = slow(texts[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in want) for k in pii.KINDS]
        extra += len([s for s in r.spans.split(",") if s]) - len(want)
    assert extra >= 0


def test_trees_add_planted_cards_and_spare_other_numbers(spark):
    rng = random.Random(3)

    def card(good=True):
        d = [rng.randint(0, 9) for _ in range(15)]
        last = next(x for x in range(10) if luhn("".join(map(str, [*d, x]))))
        return "".join(map(str, [*d, last if good else (last + 1 + rng.randint(0, 8)) % 10]))

    word = lambda: rng.choice(["red", "house", "tree", "walk", "blue"])
    rows, planted, decoys = [], 0, 0
    for i in range(600):
        kind = i % 6
        inside = card() if kind < 3 else card(False) if kind < 5 else ""
        if i % 30 == 5:  # two numbers side by side: one row of 32 digits to the strict pattern
            a, b = (True, True) if i % 60 == 5 else (False, False)
            inside = f"{card(a)} {card(b)}"
            planted, decoys = planted + 2 * a, decoys + 2 * (not a)
        rows.append((i, f"{word()} {word()} {inside} {word()} {i}"))
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = [(r.row.text[s.start : s.end], s.kind) for r in got for s in r.spans if s not in r.base]
    right = [t for t, k in added if k == 2 and luhn(t)]
    assert planted == 20 and decoys == 20 and len(right) >= 18 and len(right) >= 0.95 * len(added)


def test_trees_learn_and_read_as_sql(spark):
    table = [((k, d, 0, 0, v, 0, 0, 0), 50.0 * (v and d > 2), 50.0 * (not (v and d > 2))) for k in range(4) for d in range(8) for v in (0, 1)]
    trees = boosting.fit(table, pii.RANGES, 20)
    assert all((boosting.margin(trees, x) > 0) == (one > zero) for x, one, zero in table)
    assert boosting.threshold(trees, table, 0.98) < float("inf") and boosting.threshold([], [], 0.98) == float("inf")
    df = spark.createDataFrame([x for x, *_ in table], ", ".join(f"{f} int" for f in pii.FEATURES)).selectExpr("*", f"{boosting.as_sql(trees, pii.FEATURES)} AS m")
    assert all(abs(r.m - boosting.margin(trees, tuple(r)[:8])) < 1e-9 for r in df.collect())
