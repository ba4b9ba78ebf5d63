"""Operator 1: archives, revisit records, and the merged index."""

import hashlib
import random

from replaylab.llm import queries, warc
from replaylab.llm._common import scratch, stored
from replaylab.llm.losers import merge


def expected(pages):
    """(page_id, html) rows -> contract rows."""
    best = {}
    for page, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            best[body] = max(best.get(body, page), page)
    out = []
    for page, html in pages:
        body = (html or "").encode()
        to = best.get(body)
        revisit = to is not None and to != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def contract(df):
    return [tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)


def in_order(rows):
    found = sorted(rows, key=lambda r: (r.shard, r.position))
    keys = [(r.urlkey, r.captured, r.page_id is not None, r.page_id or 0) for r in found]
    assert keys == sorted(keys)


def test_query_on_pages(spark, sf_mid):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_mid}/pages.parquet").collect()]
    df = queries.op1_warc(spark, sf_mid)
    assert sorted(contract(df)) == sorted(expected(pages))
    in_order(df.collect())


PAGES = "page_id long, url string, html string, urlkey int, payload string, digest int, size int"


def odd_pages():
    big, other = "x" * 1000, "ö" * 500
    return [(1, "http://a.org/x", big), (2, "http://a.org/x", big), (3, "http://b.org", "x" * 999), (4, "http://b.org", "x" * 999),
            (5, None, None), (6, "", ""), (None, "http://c.org/\r\nWARC-Type: evil", big), (7, "http://[bad", other), (8, "HTTP://WWW.A.org:80/X?b=2&a=1#f", other),
            (8, "http://a.org/x", other), (9, "http://z", "WARC/1.1\r\n\r\n" * 200), (10, "http://z", "y" * 3_000_000), (10, "http://z", "y" * 3_000_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], PAGES)


def test_odd_rows(spark):
    df = frame(spark, odd_pages())
    want = sorted(expected([(p, h) for p, _, h in odd_pages()]), key=order)
    assert sorted(contract(warc.capture_history(df)), key=order) == want
    small = warc.capture_history(df.repartition(3), archive_bytes=200)
    rows = small.collect()
    assert sorted(contract(small), key=order) == want
    in_order(rows)
    assert warc.capture_history(df.limit(0)).count() == 0


def test_every_payload_is_in_the_archives(spark):
    path = scratch(spark, "t")
    warc.write_archives(frame(spark, odd_pages()), path)
    bodies = []
    for row in spark.read.format("binaryFile").load(path).collect():
        for _, _, headers, block in warc.parse(bytes(row.content)):
            assert headers["WARC-Type"] == "response" or not block
            if headers["WARC-Type"] == "response":
                bodies.append(block.decode())
    assert set(bodies) == {h or "" for _, _, h in odd_pages()}


def test_many_ranges(spark):
    rnd = random.Random(4)
    pages = [(i, "http://hot.org/" if i % 3 == 0 else f"http://h{rnd.randrange(20)}.org/{rnd.randrange(5)}", f"body {i}") for i in range(600)]
    path = scratch(spark, "t")
    warc.write_archives(frame(spark, pages).repartition(5), path, archive_bytes=4000)
    runs = stored(warc.capture_runs(spark, path), "t")
    assert runs.select("run").distinct().count() > 5
    rows = warc.merged(runs, range_captures=40).collect()
    assert len(rows) == 600 and len({r.shard for r in rows}) > 8
    hot = [sum(r.urlkey == "org,hot)/" for r in rows if r.shard == s) for s in {r.shard for r in rows}]
    assert max(hot) < 100
    in_order(rows)


def test_url_key():
    assert warc.url_key("HTTP://user@WWW.A.org:80/X?b=2&a=1#f") == "org,a)/x?a=1&b=2"
    assert warc.url_key("https://a.org") == "org,a)/"
    assert warc.url_key("https://a.org:8080/q") == "org,a:8080)/q"
    assert warc.url_key("") == "" and warc.url_key("http://[bad") == "http://[bad"


def test_loser_tree():
    rnd = random.Random(1)
    for _ in range(200):
        runs = [sorted((rnd.randrange(12),) for _ in range(rnd.randrange(6))) for _ in range(rnd.randrange(9))]
        got = list(merge(runs))
        assert [x for _, x in got] == sorted(sum(runs, []))
        assert got == sorted(got, key=lambda g: (g[1], g[0]))
