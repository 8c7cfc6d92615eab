"""WARC archives: round trips, revisits, the index."""

import gzip
import hashlib
from collections import Counter

import pytest

from quern.llm import warc
from quern.llm.warc import Lookup, reversed_host_key, round_trip

SCHEMA = "page_id long, url string, html string"


def fixture():
    big, bigger = "é" * 700, "<p>x</p>\r\n\r\n" * 200
    rows = [(i, f"https://m{i % 5}.site.example.com/p/{i % 17}?q={i}", (big, bigger, f"page {i}", "x" * 999, "y" * 1000, None, "")[i % 7]) for i in range(60)]
    return rows + [(100, "http://host.org:8080/a b", bigger), (101, None, "no url"), (102, "not a url", "z"), (None, "http://n.org/", big), (7, "http://n.org/again", big), (7, "http://n.org/again", big)]


def brute(rows, least=1000):
    out, keeper = [], {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            keeper[p] = max(i, keeper.get(p, i))
    count = Counter((h or "").encode() for _, _, h in rows)
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= least and count[p] > 1 and i != keeper.get(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", keeper[p] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", digest int").repartition(3)
    got = round_trip(df).drop("url")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_very_long_page_at_production_sizes(spark):
    long = "<p>é</p>" * 2_000_000
    rows = [(1, "http://a.org/", long), (2, "http://a.org/2", long), (3, "http://a.org/3", long[:-1])]
    got = round_trip(spark.createDataFrame(rows, SCHEMA)).drop("url")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_payloads_are_not_shuffled_while_repeated_ones_are_few(spark, tmp_path):
    pages = spark.createDataFrame(fixture(), SCHEMA)
    pages.write.parquet(f"{tmp_path}/p")
    groups = warc.keepers(pages)
    groups.write.parquet(f"{tmp_path}/g")
    plan = warc.write(spark.read.parquet(f"{tmp_path}/p"), f"file://{tmp_path}/a", spark.read.parquet(f"{tmp_path}/g"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_archives_are_gzip_members_and_lookups_find_captures(spark, tmp_path):
    base = f"file://{tmp_path}"
    pages = spark.createDataFrame(fixture(), SCHEMA).repartition(2)
    captures = warc.write(pages, f"{base}/a", warc.keepers(pages), archive_bytes=4000).cache()
    directory = warc.index(captures, f"{base}/i", block_lines=4).cache()
    assert captures.count() == 66 and directory.count() > 8
    names = {r.name for r in captures.collect()}
    assert len(names) > 2 and all(gzip.open(f"{tmp_path}/a/{n}").read().startswith(b"WARC/1.1\r\n") for n in names)
    look = Lookup(directory, f"{base}/i", f"{base}/a")
    (r,) = look.find("https://m2.site.example.com/p/15?q=32")
    assert r["page_id"] == 32 and r["warc-target-uri"].endswith("q=32") and r["payload"] == b"y" * 1000 or r["warc-type"] == "revisit"
    assert len(look.find("http://n.org/again")) == 2 and look.find("http://nowhere.org/") == []
    keys = [r["first"] for r in directory.orderBy("part", "block").collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize(("url", "key"), [("https://M.a.Example.com/x?q=1", "com,example,a,m)/x?q=1"), ("http://h.org", "org,h)/"), ("http://h.org:80/", "org,h)/"), ("http://h.org:81/", "org,h:81)/"), ("No Url", "no url"), (None, ""), ("http://[bad", "http://[bad")])
def test_keys(url, key):
    assert reversed_host_key(url) == key
