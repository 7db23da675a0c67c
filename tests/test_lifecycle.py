import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakeseek.streaming import lifecycle

EVENTS = "document_id long, seq long, ts timestamp, status string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOUR = 3600 * 10**6


def stream_of(spark, folder, per_trigger=1):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def wanted(rows, delay_us, limit_us):
    """A plain machine over events in order of time, up to the last watermark."""
    mark = (max(t for _, _, t, _ in rows) // 1000) * 1000 - delay_us
    out = []
    for d in {r[0] for r in rows}:
        status, since = "", None
        mine = sorted({(t, s, st or "") for doc, s, t, st in rows if doc == d and t < mark})
        for t, s, st in [*mine, (mark, None, None)]:
            if status == "processing" and t > since + limit_us:
                out.append((str(d), None, since + limit_us, "processing", "failed", "stuck"))
                status = "failed"
            if s is None:
                break
            if st in lifecycle.LEGAL[status]:
                out.append((str(d), s, t, status, st, "applied"))
                status, since = st, t
            else:
                out.append((str(d), s, t, status, status, "illegal"))
    return sorted(out, key=repr)


def seen(moves):
    return sorted(map(tuple, moves.withColumn("at", F.unix_micros("at")).collect()), key=repr)


def write(spark, rows, path):
    table = spark.createDataFrame([(d, s, START + timedelta(microseconds=t), st) for d, s, t, st in rows], EVENTS)
    table.coalesce(1).write.parquet(str(path))


def test_steps():
    run = lambda status, events, until=0: list(lifecycle.steps(status, 0, events, until, 10))
    assert run("", [(1, 1, "ready"), (2, 2, "processing"), (3, 3, "ready")]) == [(1, 1, "", "", "illegal"), (2, 2, "", "processing", "applied"), (3, 3, "processing", "ready", "applied")]
    assert run("processing", [], 10) == [] and run("processing", [], 11) == [(None, 10, "processing", "failed", "stuck")]
    assert run("processing", [(10, 1, "ready")], 99) == [(1, 10, "processing", "ready", "applied")]
    assert run("deleting", [(1, 1, "ready"), (2, 2, None), (3, 3, "gone"), (4, 4, "gone")], 99)[-2:] == [(3, 3, "deleting", "gone", "applied"), (4, 4, "gone", "gone", "illegal")]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_restarts_and_equals_plain_machine(spark, tmp_path, parts):
    """Events of all documents out of order within the delay, in one or several batches, with a stop between them."""
    rng = random.Random(parts)
    statuses = ["processing", "ready", "failed", "deleting", "gone", None, "unknown"]
    times = sorted(rng.randrange(0, 40 * HOUR) for _ in range(400))
    rows = [(rng.randrange(12), i, t, rng.choice(statuses[:2] if i % 2 else statuses)) for i, t in enumerate(times)]
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = rows[k * size:(k + 1) * size]
        rng.shuffle(part)
        write(spark, part + part[:20], tmp_path / f"in/part{k}")  # some come twice
        moves = lifecycle.run(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), "5 hours", 2 * 3600 * 1000)  # each run goes on from the last one's state
    shifted = [(d, s, t + int(START.timestamp() * 10**6), st) for d, s, t, st in rows]
    got, want = seen(moves), wanted(shifted, 5 * HOUR, 2 * HOUR)
    assert got == want and {w[-1] for w in want} == {"applied", "illegal", "stuck"}
    last = {}
    for r in sorted((w for w in want if w[-1] != "illegal"), key=lambda w: (w[2], w[1] or -1)):
        last[r[0]] = r[4]
    assert {r.document_id: r.status for r in lifecycle.current(moves).collect()} == {d: s for d, s in last.items() if s != "gone"}
    # nothing new: nothing is written twice
    assert seen(lifecycle.run(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), "5 hours", 2 * 3600 * 1000)) == want


def test_bounds_of_watermark_and_limit(spark, tmp_path):
    """An event at the watermark waits, one before it counts; the limit itself isn't over; rows without key, time or seq are ignored."""
    rows = [(1, 1, 0, "processing"), (2, 2, HOUR - 1, "processing"), (3, 3, HOUR, "processing"), (9, 4, 2 * HOUR, "processing"), (9, None, 5, "ready"), (None, 5, 5, "ready")]
    write(spark, rows, tmp_path / "in/a")
    moves = lifecycle.run(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), "1 hour", 3600 * 1000)
    assert {(r.document_id, r.verdict) for r in moves.collect()} == {("1", "applied"), ("2", "applied")}
    write(spark, [(9, 6, 2 * HOUR + 1000, "ready")], tmp_path / "in/b")
    moves = lifecycle.run(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), "1 hour", 3600 * 1000)
    assert {(r.document_id, r.verdict) for r in moves.collect()} == {("1", "applied"), ("1", "stuck"), ("2", "applied"), ("3", "applied")}
