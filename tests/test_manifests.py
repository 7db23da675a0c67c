import random
import re

from lakeseek.operators import incremental, manifests
from lakeseek.sources import snapshots

ROWS = "tenant_id string, doc_id string, chunk_id string, ordinal int, embed_hash string, meta_hash string"


def table(spark, rows):
    return spark.createDataFrame([(t, d, f"{d}::{o}", o, e, m) for (t, d, o), (e, m) in rows.items()], ROWS)


def told(df):
    return sorted(map(tuple, df.select("tenant_id", "doc_id", "chunk_id", "action").collect()))


def test_digest_tree_equals_diff_and_reads_only_what_differs(spark, tmp_path):
    rng = random.Random(5)
    old = {(f"t{d % 3}", f"d{d}", o): (f"e{d}.{o}", "m") for d in range(300) for o in range(200 if d == 7 else rng.randrange(1, 4))}
    new = dict(old)
    changed = [k for k in old if k[1] in ("d7", "d40", "d41")]
    for t, d, o in changed:
        if d == "d40":
            del new[t, d, o]
        elif o % 2 == 0:
            new[t, d, o] = ("other", "m") if d == "d41" else (new[t, d, o][0], "m2")
    new["t0", "d900", 0] = ("e", "m")
    log = snapshots.Log(spark, str(tmp_path / "log"))
    first = manifests.compared(log, table(spark, old), 64)
    assert {a for *_, a in told(manifests.diff(first))} == {"embed"}
    manifests.commit(first, "one")
    assert manifests.commit(first, "one")["version"] == 1  # the same run again

    second = manifests.compared(log, table(spark, new))
    assert 1 <= len(second.differing) <= 4 and second.buckets == 64
    assert told(manifests.diff(second)) == told(incremental.diff(table(spark, old), table(spark, new)))
    assert told(manifests.diff(second, unchanged=False)) == [r for r in told(manifests.diff(second)) if r[-1] != "noop"]
    read = {int(re.search(r"bucket=(\d+)", f).group(1)) for f in manifests.stored_rows(second).inputFiles()}
    assert read and read <= set(second.differing)
    assert {r.doc_id for r in manifests.moved_documents(second).collect()} == {"d7", "d40", "d41", "d900"}

    manifests.commit(second, "two")
    written = [n for n in log.names("data") if n not in {x["place"].split("/")[1] for x in log.state(1)["buckets"].values()}]
    assert len(written) == 1 and {int(n.split("=")[1]) for n in log.names(f"data/{written[0]}/level=rows") if n.startswith("bucket=")} <= set(second.differing)
    like = table(spark, old)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(manifests.load(log, like)) == rows(table(spark, new)) and rows(manifests.load(log, like, 1)) == rows(like)
    assert manifests.compared(log, table(spark, new)).differing == []
    # old folders that the last version points to stay
    assert snapshots.clean(log, keep=1) == [] and rows(manifests.load(log, like)) == rows(table(spark, new))


def test_empty_and_incomplete(spark, tmp_path):
    log = snapshots.Log(spark, str(tmp_path / "log"))
    none = spark.createDataFrame([("t", "d", "c", 0, None, "m"), (None, "d", "c", 0, "e", "m")], ROWS)
    change = manifests.compared(log, none)
    assert change.differing == [] and manifests.diff(change).count() == 0
    manifests.commit(change, "empty")
    one = spark.createDataFrame([("t", "d", "c", None, "e", "m")] * 2, ROWS)
    manifests.commit(manifests.compared(log, one), "one")
    gone = manifests.compared(log, none)
    assert told(manifests.diff(gone)) == [("t", "d", "c", "delete")] * 2
    assert manifests.commit(gone, "gone")["buckets"] == {} and manifests.load(log, one).count() == 0
