import random
import re
import sys

from lakeseek.operators import rewrite


def plain(question, rules):
    for shortcut, full in sorted(rules, key=lambda r: (-len(r[0]), r[0], r[1])):
        question = re.sub(rf"\b{re.escape(shortcut)}\b", lambda _, full=full: full, question, flags=re.IGNORECASE)
    return question


def run(spark, questions, synonyms):
    q = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(questions)], "id long, tenant_id string, question string")
    return [r.retrieval_question for r in rewrite.rewritten(q, spark.createDataFrame(synonyms, "tenant_id string, shortcut string, full string")).orderBy("id").collect()]


def test_folded_joins_what_matches_in_any_case():
    for c in map(chr, range(sys.maxunicode + 1)):
        for d in {c.lower(), c.upper()} - {c}:
            if len(d) == 1 and re.fullmatch(re.escape(c), d, re.IGNORECASE):
                assert rewrite.folded(c) == rewrite.folded(d), (c, d)
    assert rewrite.folded("\u212a") == "k" and rewrite.folded("\u017f") == "s" and rewrite.folded("\u0130") == rewrite.folded("I")


def test_chains_odd_rules_and_nulls(spark):
    rules = [
        ("t", "k8s", "kubernetes x"), ("t", "x", "y z"), ("t", "z", "k8s"), ("t", "de la", "du"), ("t", "c++", "plus"), ("t", "++", "and"), ("t", ".net", "dot"), ("t", "adot", "grown"),
        ("u", "x", "only u"), (None, "x", "none"), ("t", "w", None), ("t", "", "nothing"), ("u", "only", r"\1 $0"), ("u", "stra\u00dfe", "way"), ("u", "empty", ""),
    ]
    asked = [("t", "run K8S now"), ("t", "nothing here"), ("t", "De LA mar"), ("t", "a.net b"), ("t", "a++b, c++ c++d"), ("u", "x K8S"), ("u", "STRA\u1e9eE an empty one"), ("v", "x"), (None, "x"), ("t", None), ("t", ""), ("t", "run K8S now")]
    want = [x if x is None or t is None else plain(x, [(s, f) for tenant, s, f in rules if tenant == t and s and f is not None]) for t, x in asked]
    assert run(spark, asked, rules) == want
    assert want[0] == "run kubernetes y k8s now" and want[3] == "grown b"  # a rule on what another has put in; a word grown together
    assert run(spark, asked, [("w", "a", "b")]) == [x for _, x in asked]


def test_ten_thousand_rules_a_tenant(spark):
    """A question carries only the rules whose words it holds, whatever the size of its tenant's dictionary."""
    rng = random.Random(1)
    rules = [(t, f"w{i}" if i % 3 else f"w{i} w{i + 1}", f"w{i + 2} full{i}") for t in ("t", "u") for i in range(10000)]
    asked = [(rng.choice("tu"), " ".join(f"W{rng.randrange(12000)}" for _ in range(6))) for _ in range(60)]
    part = [r for r in rules if int(r[1].split()[0][1:]) % 50 < 10]
    assert run(spark, asked[:12], part) == [plain(x, [(s, f) for tenant, s, f in part if tenant == t]) for t, x in asked[:12]]
    q = spark.createDataFrame([(str(i), t, x) for i, (t, x) in enumerate(asked)], "id string, tenant_id string, question string")
    chainless = spark.createDataFrame([(t, s, f"full{i}") for i, (t, s, _) in enumerate(rules)], "tenant_id string, shortcut string, full string")
    assert max(len(r.rules) for r in rewrite.applicable(q, chainless).collect()) <= 12
