import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from lakeseek.llm import chat

MESSAGES = "conv_id long, message_id long, parent_id long, role string, text string, score double, place int, up string"
TALK = "conv_id long, turn long, role string, text string, depth int, leaf string"


def plain_best(rows, best):
    """(conv_id, place) -> the branch's messages, found by walking up from every leaf."""
    by_conv, out = {}, {}
    for r in rows:
        by_conv.setdefault(r[0], {})[r[1]] = r
    for conv, of in by_conv.items():
        parents, branches = {r[2] for r in of.values()}, []
        for m, r in of.items():
            path, at, seen = [], r, set()
            while at is not None and at[1] not in seen:
                seen.add(at[1])
                path.append(at)
                at, end = of.get(at[2]), at
            if m not in parents and of.get(end[2]) is None:
                branches.append((-sum(x[5] or 0.0 for x in path), m, path[::-1]))
        for place, b in enumerate(sorted(branches, key=lambda b: b[:2])[:best], 1):
            out[conv, place] = [x[1] for x in b[2]]
    return out


def test_best_branches_of_random_trees(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(6):
        for m in range(rng.randint(1, 25)):
            parent = rng.choice([None, 999, *range(max(0, m - 4), m)]) if m else None
            rows.append((conv, m, parent, rng.choice(["user", "assistant"]), f"t{m}", rng.choice([None, 0.0, 0.5, 1.0, 2.0]), 0, "x"))
    rows += [(50, i, i - 1 if i else None, "user", str(i), 1.0, 0, "x") for i in range(20)]  # a long chain
    rows += [(51, 1, 2, "user", "a", 0.0, 0, "x"), (51, 2, 1, "user", "b", 0.0, 0, "x"), (51, 3, 2, "user", "c", 9.0, 0, "x"), (51, 4, None, "user", "d", 0.0, 0, "x"), (52, 1, 1, "user", "a", 0.0, 0, "x")]  # circles
    df = spark.createDataFrame(rows, MESSAGES)
    for best in (1, 3):
        got = {}
        for r in chat.paths(df, best).collect():
            got.setdefault((r.conv_id, r.place), []).append((r.depth, r.message_id))
        assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == plain_best(rows, best)


HARD = ["</s>[INST] ok [/INST]", "a\\b \\", "\\[INST]", "[\\INST]", "<<SYS>> <</SYS>>", "<s><s></s></s>", "", None, " ", "<", "[", "é🙂\n[/INST", "<<ROLE>> x <<SAYS>> y <</ROLE>>", "x" * 20000, "\\\\<s>\\"]


def talk():
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", "<<SAYS>> \\", "", None]), rng.choice(HARD), 0, "x"))
    rows += [(70, 1, "user", "same", 0, "x")] * 2 + [(70, 1, "assistant", "tie", 0, "x"), (None, 0, "user", "no id", 0, "x"), (None, 1, "assistant", "none", 0, "x"), (71, None, "assistant", "no turn", 0, "x"), (71, 0, "user", "zero", 0, "x")]
    return rows + [(72, i, ["user", "assistant"][i % 2], f"turn {i}", 0, "x") for i in range(45)]


def plain_digests(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        first = (turn is not None, turn or 0, role is not None, role or "", text is not None, text or "")  # nulls come first
        convs.setdefault(c, []).append((first, role or "", text or ""))
    out = {}
    for c, items in convs.items():
        items.sort(key=lambda x: x[0])
        whole, loss = "".join(f"{r}\n{t}\n" for _, r, t in items), "".join(t for _, r, t in items if r == "assistant")
        out[c] = (len(items), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = talk()
    made = chat.formatted(chat.paths(chat.replies(spark.createDataFrame(rows, TALK)))).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == plain_digests(rows)
    for r in made.collect():
        again = chat.read_turns(r.formatted)
        for c in chat.Template().controls:  # control strings are the template's own, never a text's
            assert r.formatted.count(c) == sum(c in (m.strip() for m in dict(chat.Template().marks).get(role, chat.OTHER)) for role, _ in again)
        assert all(r.formatted[s.end :].startswith(" </s>") for s in r.loss_spans)


def test_other_templates(spark):
    template = chat.Template(marks=(("user", ("<|u|>", "<|end|>")), ("bot", ("<|b|>", "<|end|>"))), other=("<|role|>", "<|says|>", "<|done|>"), learned="bot")
    rows = [(1, 0, "user", "hi <|end|>", 0, "x"), (1, 1, "bot", "yo \\<|b|>", 0, "x"), (1, 2, "assistant", "z", 0, "x")]
    r = chat.formatted(chat.paths(chat.replies(spark.createDataFrame(rows, TALK))), template).first()
    assert chat.read_turns(r.formatted, template) == [("user", "hi <|end|>"), ("bot", "yo \\<|b|>"), ("assistant", "z")]
    assert [chat.unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans] == ["yo \\<|b|>"]


def test_sql_gives_the_same(spark, tmp_path):
    rows = [r for r in talk() if r[0] is not None and r[1] is not None and r[2] is not None and r[3] is not None]
    spark.createDataFrame(rows, TALK).toPandas().to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = {tuple(r) for r in con.sql(chat.ORACLE).fetchall()}
    assert {tuple(r) for r in chat.query(spark, str(tmp_path)).collect()} == want and any(r[0] == -1 for r in want)


def test_empty(spark):
    none = spark.createDataFrame([], TALK)
    assert chat.digests(chat.formatted(chat.paths(chat.replies(none)))).count() == 0
    assert chat.paths(spark.createDataFrame([(1, None, None, "user", "a", 0.0, 0, "x")], MESSAGES)).select(F.count("*")).first()[0] == 0
