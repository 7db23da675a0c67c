import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lakeseek.llm import pieces


@pytest.fixture(scope="module")
def ours():
    return pieces.Transducer(pieces.load())


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


CASES = ["", " ", "   ", "a", " a  b ", "x ", "Hello  world\n\tété 你好 🙂\x00 a", "aaaaaaaaaaaaaaaaaaaa", "▁a ▁▁b", " ​", "=" * 300, "ab" * 400, " " * 100 + "x", "\r\n\r\n", "١٢٣ नमस्ते"]


def test_same_ids_as_the_library(ours, theirs, spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCéü ñ,.-_()0123456789\n"
    texts = CASES + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinrst ") for _ in range(60)) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert ours.encode(t) == theirs.encode(t), t
        assert ours.decode(ours.encode(t)) == t.replace("▁", " ")
        assert ours.decode(ours.encode(t)) == theirs.decode(theirs.encode(t))
    assert ours.decode([1, 2]) == ""
    assert "�" in ours.decode([ours.byte[0xFF], ours.byte[0xC3]])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
def test_compiled_normaliser(rule, collapse, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(pieces.MODEL, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    spec = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = collapse
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    theirs, ours, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(pieces.load(path)), random.Random(7)
    letters = "aeE n\u0301\u0308\u0327éﬁ½①ＡＢ\u3000\u00a0\u200b\t\n\u1100\u1161\u11a8가ｶﾞ\u0345ΑΣς²ǆ "
    for t in CASES + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(1500)]:
        assert ours.encode(t) == theirs.encode(t), (t, ours.normal(t))
        assert ours.decode(ours.encode(t)) == theirs.decode(theirs.encode(t)) == ours.plain(t), t


def test_shortest_path_of_weights():
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab"]
    scores = [0.0, -3.0, -2.0, -2.0, -1.0, -2.5, -6.0]
    t = pieces.Transducer({"pieces": names, "scores": scores, "types": [2] + [1] * 6, "bpe": False, "prefix": True})
    assert [names[i] for i in t.encode("ab")] == ["▁", "ab"]
    assert [names[i] for i in t.encode("abcb")] == ["▁", "ab", "<unk>", "b"]


def test_dataframes(spark, theirs):
    rows = [(i, t, 1, [i]) for i, t in enumerate(CASES)] + [(None, None, 1, [0]), (3, "a", 1, [0])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids int, ids array<int>")
    encoded = pieces.encode(df)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(i), theirs.encode(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded).collect()) == sorted((str(i), (t or "").replace("▁", " ")) for i, t, *_ in rows)
    for r in pieces.digests(df).where("doc_id is not null").collect():
        ids = np.array(theirs.encode(CASES[r.doc_id]), "<i4")
        assert (r.n_ids, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
    assert pieces.encode(df.limit(0)).count() == 0


def test_whole_table(spark, theirs):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = pieces.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got[::7]:
        ids = theirs.encode(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
