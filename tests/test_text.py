from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeseek.operators import chunking, context, redaction
from lakeseek.sources import corpora, html


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", t, "t", []) for i, t in enumerate(texts)], "doc_id string, text string, tenant_id string, acl_tags array<string>")


def greedy(n, most, overlap):
    out, at = [], 0
    step = most - max(0, min(overlap, most - 1))
    while n:
        out.append((at, min(n, at + most)))
        if at + most >= n:
            break
        at += step
    return out


def test_windows(spark):
    texts = [" ".join(f"w{j}" for j in range(n)) for n in (0, 1, 9, 10, 11, 15, 18, 27)]
    for most, overlap in ((10, 2), (5, 2), (4, 9)):
        rows = chunking.chunk(docs(spark, texts), most, overlap).collect()
        got = {(r.doc_id, r.ordinal): (int(r.tokens[0][1:]), int(r.tokens[-1][1:]) + 1) for r in rows}
        want = {(f"d{i}", k): w for i, t in enumerate(texts) for k, w in enumerate(greedy(len(t.split()), most, overlap))}
        assert got == want
    assert chunking.chunk(docs(spark, ["a b"])).first().chunk_id == "d0::000000"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=3), max_size=25), min_size=1, max_size=6))
def test_every_word_survives(spark, texts):
    rows = chunking.chunk(docs(spark, ["\n\n".join(t) for t in texts]), 7, 3).collect()
    for i, t in enumerate(texts):
        parts = sorted((r.ordinal, r.tokens) for r in rows if r.doc_id == f"d{i}")
        assert [w for k, p in parts for w in (p if k == 0 else p[3:])] == t


def test_paragraphs_and_pages(spark):
    assert html.text_of("<html><head><title>x</title></head><body><h1>A &amp; b</h1><script>no</script><p>one <b>two</b><br>three</p></body>") == "A & b\n\none two\n\nthree"
    assert html.text_of("<p> </p>") is None and html.text_of(None) is None


def test_personal_data_fixtures(spark):
    cases = {
        "Contact me at alice@example.com or call (555) 123-4567.": "Contact me at [EMAIL] or call [PHONE].",
        "Send mail to bob@corp.org please.": "Send mail to [EMAIL] please.", "Call 555-867-5309 now.": "Call [PHONE] now.",
        "My SSN is 123-45-6789 and I need help.": "My SSN is [SSN] and I need help.", "Card number: 4111 1111 1111 1111 expires soon.": "Card number: [CREDIT_CARD] expires soon.",
        "The quick brown fox jumps over the lazy dog.": "The quick brown fox jumps over the lazy dog.",
    }
    df = docs(spark, list(cases))
    got = {r.doc_id: r.text for r in redaction.ingested(df).collect()}
    assert [got[f"d{i}"] for i in range(len(cases))] == list(cases.values())
    assert [r.pii_types for r in redaction.ingested(df, "keep").orderBy("doc_id").limit(1).collect()] == [["EMAIL", "PHONE"]]


def test_overlapping_and_touching_spans(spark):
    rows = [("Find Bob at 123 Main St.", [("ADDRESS", 12, 23), ("PERSON", 12, 15)]), ("aaa555-12-3456@example.org and more", [("SSN", 3, 14), ("EMAIL", 0, 26)]), ("abcdef", [("A", 0, 3), ("B", 3, 6)]), ("abcdef", [])]
    df = spark.createDataFrame(rows, "text string, s array<struct<type:string,start:int,end:int>>")
    assert [r[0] for r in df.select(redaction.redacted(F.col("text"), F.col("s"))).collect()] == ["Find Bob at [ADDRESS].", "[EMAIL] and more", "[A][B]", "abcdef"]


def test_audit_is_free_of_values(spark):
    rows = docs(spark, ["a@b.org a@b.org c@d.org"]).withColumn("chunk_id", F.lit("c")).withColumn("pii_spans", redaction.spans(F.col("text")))
    log = redaction.audit(rows, F.lit(1.0), "salt", True).collect()
    assert [log[0].value_hash == log[1].value_hash, log[0].value_hash == log[2].value_hash, "a@b.org" in str(log)] == [True, False, False]


def test_packing_stops_at_first_overflow(spark):
    ranked = spark.createDataFrame([(1, "a", 1, "t", "s", "x " * 50), (1, "a", 2, "t", "s", "x " * 50), (1, "b", 3, "", None, "y " * 5), (1, "c", 4, "t", "s", "z " * 90), (1, "d", 5, "t", "s", "w")], "query_id int, chunk_id string, rank int, title string, source string, text string")
    packed = context.pack(ranked, 60)
    assert [(r.chunk_id, r.marker) for r in packed.orderBy("marker").collect()] == [("a", 1), ("b", 2)]
    assert [r.chunk_id for r in context.pack(ranked, 1).collect()] == ["a"]
    assert context.contexts(packed).first().context.endswith("[2]\ny y y y y ")
    assert context.effective_budget(4000, 0.1) == 3600


def test_markers_and_citations(spark):
    df = spark.createDataFrame([("see [2] and [1][2]", [7]), ("none", None)], "a string, c array<int>")
    assert [r[0] for r in df.select(context.markers(F.col("a"), F.col("c"))).collect()] == [[1, 2, 7], []]


def test_corpora(spark, tmp_path):
    rows = spark.createDataFrame([(0, [("A", ["x", "y"]), ("B", ["z"])]), (1, [("A", ["other"]), ("C", ["c"])])], "row_no long, context array<struct<title:string,sentences:array<string>>>")
    assert sorted(tuple(r) for r in corpora.titled_paragraphs(rows).select("doc_id", "text").collect()) == [("A", "x y"), ("B", "z"), ("C", "c")]
    assert corpora.titled_paragraphs(rows, 1).count() == 2
    (tmp_path / "p.jsonl").write_text('{"id": "1", "abstract": "a"}\n\n{"id": "2", "text": "b"}\n')
    assert sorted(r.text for r in corpora.papers(spark, str(tmp_path / "p.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "r1.json").write_text('[{"latency_ms": 1, "metrics": {"m": 0.5}}, {"cost_usd": 2}]')
    (tmp_path / "r2.json").write_text('{"results": [{"latency_ms": 3}]}')
    assert corpora.run_records(spark, str(tmp_path / "r1.json")).count() == 2 and corpora.run_records(spark, str(tmp_path / "r2.json")).first().latency_ms == 3
    try:
        corpora.loader("nope")
        raise AssertionError
    except ValueError:
        pass
    files = spark.createDataFrame([("text/plain", bytearray(b"ok\xff")), ("application/zip", bytearray(b"x"))], "content_type string, content binary")
    assert [r.reason for r in corpora.accepted(files).collect()] == [None, "unsupported type"]
