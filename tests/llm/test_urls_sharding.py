import math
import zlib

import xxhash

from lakeseek.llm import sharding, urls


def slow_verdict(url):
    rest = None if url is None or "://" not in url else url.split("://", 1)[1]
    if rest is None:
        host = path = ""
    else:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max(((len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark):
    cases = [None, "", "no scheme/en/7", "http://COM/en/x", "http://a.b.example.com/en/77?q=1#x", "http://example.com/en/8", "http://notexample.com/en/7", "http://x.net/de/8", "http://a.example.net/de/8/9", "http://x.org",
             "http://x.org?/es/", "http://x.org#/es/", "https://Q.ORG/es/", "ftp://é.ÉXAMPLE.com/en/7", "http:///en/", "http://com./en/", "http://" + "a." * 3000 + "com/en/" + "x" * 5000, "http://u:p@h.com:80/en/", "x://y://z.com/en/", "http://org/es/\n?x"]
    rows = [(i % 15, u, "h", 1) for i, u in enumerate(cases * 2)] + [(None, cases[4], "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule int")
    rules = spark.createDataFrame(urls.RULES + urls.RULES[:1], "host string, path string, verdict string")
    got = urls.judge_urls(pages, rules).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *slow_verdict(u)) for i, u, *_ in rows], key=key)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}
    both = spark.createDataFrame([("org", "/es/", "allow"), ("org", "/es/", "block")], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge_urls(pages.where("url = 'https://Q.ORG/es/'"), both).collect()} == {"block"}


def test_rules_of_the_contract(spark, tmp_path):
    assert urls.RULES == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    want = {"http://a.com/en/1": "block", "http://a.example.com/en/71": "allow", "http://a.net/de/8": "allow", "http://example.net/de/7": "allow", "http://www.example.net/de/8": "block", "http://a.org/es/": "block", "http://a.org/en/": "allow"}
    rows = list(enumerate(want))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.verdict for r in urls.query(spark, str(tmp_path)).collect()} == {i: want[u] for i, u in rows}


def test_large_rule_tables_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (2, "http://b.com/")], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    whole = sorted(map(str, urls.judge_urls(pages, rules).collect()))
    monkeypatch.setattr(urls, "BROADCAST_RULES", 1)
    assert sorted(map(str, urls.judge_urls(pages, rules).collect())) == whole


def test_shards(spark):
    rows = [(i, f"text {i}" if i % 3 else None, 0, "s") for i in range(3000)] + [(7, "é🙂", 0, "s"), (None, "x", 0, "s"), (None, "x", 0, "s"), (5, "same", 0, "s"), (5, "same", 0, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, copies string")
    got = sharding.shard_documents(df, [1.0] * 8).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - 375) < 90
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    assert 0 < sum(r.grown_shard == 8 for r in got) < 3000 / 6
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.shard_documents(df.limit(0), [1.0] * 8).count() == 0
    heavy = sharding.shard_documents(df, [3.0, 1.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in heavy}[0] / len(rows) - 0.75) < 0.05
    with __import__("pytest").raises(ValueError):
        sharding.rendezvous(df.doc_id, [0.0])


def test_winners_and_slots_by_plain_python(spark):
    rows = sharding.query(spark, "/root/testdata/sf0.001").collect()

    def winner(key, n):
        def score(shard):
            draw = xxhash.xxh64_intdigest(str(key).encode(), xxhash.xxh64_intdigest(f"shard-{shard}".encode(), 42)) >> 12
            return 1.0 / -math.log((draw + 0.5) / (1 << 52))

        return max(range(n), key=score)

    assert all((r.shard, r.grown_shard) == (winner(r.doc_id, 8), winner(r.doc_id, 9)) for r in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPY_BLOCK", 7)
    df = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 21 + [(2, "b")], "doc_id long, text string")
    rows = sharding.shard_documents(df, [1.0] * 3).collect()
    assert len(rows) == 72
    for shard in range(3):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
