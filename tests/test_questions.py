import os
import shutil

import pytest
from pyspark.sql import functions as F

from lakeseek.operators import bm25, inverted
from lakeseek.sources.snapshots import Log
from lakeseek.streaming import questions

CHUNK = "chunk_id string, tenant_id string, acl_tags array<string>, collection_id string, seq long, text string"
ASKED = "query_id long, question string, tenant_id string, caller_tags array<string>, query_collection string"
WORDS = "red green blue cyan black white amber olive".split()


def chunks(spark, n=40, first=0):
    rows = [(f"c{i}", "t" if i % 3 else "u", ["board"] if i % 5 == 0 else [], "en", i, " ".join(WORDS[(i * j) % 8] for j in range(1, 9))) for i in range(first, first + n)]
    return spark.createDataFrame(rows, CHUNK)


def asked(spark, ids):
    return spark.createDataFrame([(i, f"{WORDS[i % 8]} {WORDS[(i * 3 + 1) % 8]}", "t" if i % 2 else "u", ["board"] if i % 4 == 0 else [], None) for i in ids], ASKED).coalesce(1)


def stream(spark, folder):
    return spark.readStream.schema(ASKED).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(table):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in table.collect())


def test_batches_restarts_and_versions(spark, tmp_path):
    inbox, out, log = str(tmp_path / "in"), str(tmp_path / "out"), Log(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="no version"):
        questions.run(stream(spark, str(tmp_path)), log, out)
    base = chunks(spark)
    first = questions.stored(log, "one", base)
    assert questions.stored(log, "one", base)["version"] == first["version"] == 1
    asked(spark, range(3)).write.mode("append").parquet(inbox)
    asked(spark, range(3, 6)).write.mode("append").parquet(inbox)
    told = questions.run(stream(spark, inbox), log, out, k=5)
    assert rows(told) == rows(bm25.top_k(asked(spark, range(6)), base, 5)) and len(os.listdir(f"{out}/answers")) == 2
    # the index moves on, the stream does not
    questions.stored(log, "two", base.where("seq < 10"))
    asked(spark, range(6, 8)).write.mode("append").parquet(inbox)
    told = questions.run(stream(spark, inbox), log, out, k=5)
    assert rows(told) == rows(bm25.top_k(asked(spark, range(8)), base, 5)) and {r.version for r in told.collect()} == {1}
    with pytest.raises(ValueError, match="answers from version 1"):
        questions.run(stream(spark, inbox), log, out, version=2)
    questions.moved(Log(spark, out), 2, "move")
    questions.moved(Log(spark, out), 2, "move")
    asked(spark, [8]).write.mode("append").parquet(inbox)
    told = questions.run(stream(spark, inbox), log, out, k=5)
    assert rows(told.where("version = 2")) == rows(bm25.top_k(asked(spark, [8]), base.where("seq < 10"), 5)) and told.where("version = 1").select("query_id").distinct().count() == 8


def test_replayed_and_half_written_batches(spark, tmp_path):
    inbox, out, log = str(tmp_path / "in"), str(tmp_path / "out"), Log(spark, str(tmp_path / "index"))
    base = chunks(spark)
    questions.stored(log, "one", base)
    for i in range(3):
        asked(spark, [i]).write.mode("append").parquet(inbox)
    want = rows(questions.run(stream(spark, inbox), log, out, k=5))
    # the commit log of the last batch is lost with the driver, after its answers were written
    commits = f"{out}/progress/commits"
    for name in ("2", ".2.crc"):
        os.remove(f"{commits}/{name}")
    made = []

    def opener(log, version, k):
        search = questions.by_lists(log, version, k)

        def counted(batch):
            made.append(1)
            return search(batch)

        return counted

    assert rows(questions.run(stream(spark, inbox), log, out, opener=opener, k=5)) == want and not made
    # and again, with answers that were only half written: readers don't see them, the replay writes them anew
    for name in ("2", ".2.crc"):
        os.remove(f"{commits}/{name}")
    os.remove(f"{out}/answers/batch=2/_SUCCESS")
    assert {r[0] for r in rows(questions.answers(spark, out))} < {r[0] for r in want}
    assert rows(questions.run(stream(spark, inbox), log, out, opener=opener, k=5)) == want and len(made) == 1
    shutil.rmtree(f"{out}/answers")
    assert questions.answers(spark, out).count() == 0


def test_the_block_index_answers_too(spark, tmp_path):
    inbox, log = str(tmp_path / "in"), Log(spark, str(tmp_path / "index"))
    base = chunks(spark)
    index = inverted.added(spark, log.path, base, "one")
    asked(spark, range(4)).write.parquet(inbox)
    told = questions.run(stream(spark, inbox), log, str(tmp_path / "out"), version=index.version, opener=questions.by_blocks, k=5)
    assert rows(told) == rows(bm25.top_k(asked(spark, range(4)), base, 5))
    assert told.select(F.max("version")).first()[0] == index.version
