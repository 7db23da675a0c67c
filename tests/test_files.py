import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeseek.sources import corpora, docx, files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{}"/></Relationships>'


def word(body: str, part: str = "word/document.xml", rels: bool = True, namespace: str = W, head: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if rels:
            z.writestr("_rels/.rels", RELS.format(part))
        z.writestr(part, f'{head}<w:document xmlns:w="{namespace}" xmlns:mc="{docx.COMPATIBILITY}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r><w:t xml:space='preserve'>{r}</w:t></w:r>" for r in runs) + "</w:p>"


@pytest.mark.parametrize(
    "body, text",
    [
        (p("Hello ", "wor", "ld") + p(" \t ") + p("a  b\n c"), "Hello world\n\na b c"),
        ("<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:noBreakHyphen/><w:t>d</w:t></w:r></w:p>", "a b c-d"),
        ("<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:r><w:instrText>PAGE</w:instrText></w:r></w:p>", "kept"),
        ("<w:p><w:moveFrom><w:r><w:t>old</w:t></w:r></w:moveFrom></w:p><w:moveFrom>" + p("x") + "</w:moveFrom><w:p><w:moveTo><w:r><w:t>new</w:t></w:r></w:moveTo></w:p>", "new"),
        ("<w:tbl><w:tr><w:tc>" + p("c1") + "</w:tc><w:tc>" + p("c2") + "</w:tc></w:tr></w:tbl>", "c1\n\nc2"),
        ("<w:p><w:r><w:t>out</w:t><mc:AlternateContent><mc:Choice>" + p("box") + "</mc:Choice><mc:Fallback>" + p("box") + "</mc:Fallback></mc:AlternateContent><w:t>side</w:t></w:r></w:p>", "box\n\noutside"),
        (p("&lt;&amp;&#233;", "\U0001f600"), "<&é\U0001f600"),
    ],
)
def test_shown_text(body, text):
    assert docx.text_of(word(body)) == (text, None)


def test_where_the_main_part_lies():
    assert docx.text_of(word(p("a"), rels=False))[0] == "a"
    assert docx.text_of(word(p("a"), part="x/main.xml"))[0] == "a"
    assert docx.text_of(word(p("a"), namespace="http://purl.oclc.org/ooxml/wordprocessingml/main"))[0] == "a"


def test_what_is_refused(monkeypatch):
    good = word(p("some text " * 500))
    assert docx.text_of(None) == (None, None)
    for bad in (b"", b"plain", good[: len(good) // 2], word(p("a"))[:-30], word("<w:p>"), word(p("a"), part="x/main.xml", rels=False)):
        assert docx.text_of(bad) == (None, "not a word file")
    broken = bytearray(good)
    broken[good.index(b"word/document.xml") + 40] ^= 255
    assert docx.text_of(bytes(broken))[1] == "not a word file"
    assert docx.text_of(word(p(" ")) ) == (None, "no text")
    lol = '<!DOCTYPE w [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]>'
    assert docx.text_of(word(p("&b;"), head=lol)) == (None, "declares entities")
    monkeypatch.setattr(docx, "MAX_UNPACKED", 100_000)
    bomb = word(p("a" * 10_000_000))
    assert len(bomb) < 20_000 and docx.text_of(bomb) == (None, "too large unpacked")


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    given = {
        "a.txt": b"plain \xff text", "b.MD": b"# title", "c.html": b"<p>one</p><script>no</script><p>two</p>", "deep/d.docx": word(p("one") + p("two")), "deep/er/e.htm": b"<head>x</head>",
        "deep/f.docx": b"PK nonsense", "g.pdf": b"%PDF", "no_ending": b"x", "deep/er/h.txt": b"  ", "empty.txt": b"", "i.txt": b"x" * 5000, "j.docx": word(p("y" * 100_000)) + b"\0" * 5000,
    }
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    table = files.folder(spark, str(tmp_path), max_bytes=4000)
    got = {r.path.split(str(tmp_path) + "/")[1]: (r.text, r.error, r.detail) for r in table.collect()}
    assert got == {
        "a.txt": ("plain � text", None, None), "b.MD": ("# title", None, None), "c.html": ("one\n\ntwo", None, None), "deep/d.docx": ("one\n\ntwo", None, None),
        "deep/er/e.htm": (None, "ParserError", "no text"), "deep/f.docx": (None, "ParserError", "not a word file"), "g.pdf": (None, "UnsupportedTypeError", "unsupported type"),
        "no_ending": (None, "UnsupportedTypeError", "unsupported type"), "deep/er/h.txt": (None, "ParserError", "no text"), "i.txt": (None, "UnsupportedTypeError", "too large"), "j.docx": (None, "UnsupportedTypeError", "too large"),
    }
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan and plan.count("content#") > 0
    rejects = table.where("error is not null and detail = 'too large'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in rejects


def test_rows_without_content_or_of_other_types(spark):
    rows = spark.createDataFrame([(1, None, "text/plain"), (2, bytearray(b"x"), None), (3, bytearray(word(p("ok"))), docx.CONTENT_TYPE), (4, None, docx.CONTENT_TYPE)], "i int, content binary, content_type string")
    got = {r.i: (r.text, r.error) for r in files.parsed(rows).collect()}
    assert got[1] == (None, "KeyError") and got[3] == ("ok", None) and got[4] == (None, "KeyError") and got[2][1] == "UnsupportedTypeError"
    assert files.parsed(rows.limit(0)).count() == 0
    assert docx.CONTENT_TYPE in corpora.TEXT_TYPES and spark.range(1).select(files.type_of(F.lit("s3://x.y/A.DocX")).alias("t")).first().t == docx.CONTENT_TYPE
