"""The paced fetch, its back-off, and the cache, with transports that refuse, drop and count."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from citeloom.sources import fetch
from citeloom.sources.fetch import Bucket, Policy, Response

QUICK = Policy(rate=1e9, tasks=2, tries=4, first_wait=0.0)


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_bucket_keeps_the_rate():
    clock = Clock()
    bucket = Bucket(2.0, 3.0, clock, clock.sleep)
    for _ in range(3):
        bucket.take()
    assert clock.now == 0  # the burst
    for _ in range(10):
        bucket.take()
    assert clock.now == pytest.approx(5.0)
    clock.now += 100
    for _ in range(4):
        bucket.take()
    assert clock.now == pytest.approx(105.5)


def test_back_off():
    clock, policy = Clock(), Policy(tries=5, first_wait=1.0, longest_wait=5.0)
    bucket = Bucket(1e9, 1.0, clock, clock.sleep)
    answers = iter([Response(429), Response(429, retry_after=4.0), Response(503), ConnectionError("reset"), Response(200, "ok")])

    def transport(url):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    assert fetch.call("u", transport, policy, bucket)[0].body == "ok"
    # Doubled each time, the server's wish if that is longer, five seconds at most.
    assert [s for s in clock.slept if s > 1e-6] == pytest.approx([1.0, 4.0, 4.0, 5.0])
    assert fetch.call("u", lambda u: Response(404), policy, bucket) == (None, "HTTP 404", 1)
    assert fetch.call("u", lambda u: 1 / 0, policy, bucket)[1:] == ("ZeroDivisionError: division by zero", 5)


JATS = '<article><front><article-meta><article-id pub-id-type="doi">10.1/j</article-id><title-group><article-title>Title</article-title></title-group></article-meta></front><body><sec><title>Data availability</title><p>Deposited as GSE12345.</p></sec></body></article>'


def counted(folder):
    """A transport that keeps what it was asked in a folder, one line a call."""

    def transport(url):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(url + "\n")
        with open(f"{folder}/{os.getpid()}-{threading.get_ident()}") as f:
            before = f.read().split("\n").count(url)
        if "busy" in url and before < 3:
            return Response(429)
        if "gone" in url:
            return Response(404)
        if "dropped" in url:
            raise ConnectionResetError("peer")
        if url.endswith("id=777"):
            return Response(200, "<error>no such id</error>", "text/xml")
        if url.startswith(fetch.EFETCH):
            return Response(200, JATS, "text/xml")
        return Response(200, "<html><body><h1>Page</h1><p>See PXD000001 in PRIDE.</p></body></html>", "text/html")

    return transport


def calls(folder):
    out = {}
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        for url in open(f"{folder}/{name}").read().split():
            out[url] = out.get(url, 0) + 1
    return out


def test_reruns_fetch_what_lacks(spark, tmp_path):
    urls = ["https://pmc.ncbi.nlm.nih.gov/articles/PMC12345/", "https://a.org/one", "https://a.org/two", "https://a.org/busy", "https://a.org/gone", "https://a.org/dropped", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC7770/"]
    frame = spark.createDataFrame([(u,) for u in [*urls, urls[1], None]], "url string")
    cache = fetch.Cache(spark, str(tmp_path / "cache"))
    got = {r.url: r for r in cache.get(frame, counted(tmp_path / "first"), QUICK).collect()}
    assert set(got) == set(urls)
    assert {u for u, r in got.items() if r.content is None} == {urls[4], urls[5]}
    assert got[urls[4]].error == "HTTP 404" and got[urls[5]].error.startswith("ConnectionResetError") and got[urls[3]].calls == 3
    seen = calls(tmp_path / "first")
    assert seen[fetch.EFETCH + "12345"] == 1 and seen["https://a.org/busy"] == 3 and seen["https://a.org/dropped"] == 4 and seen["https://a.org/gone"] == 1 and sum(seen.values()) == 12
    # One body for the pages that are alike, and for the articles.
    assert spark.read.parquet(str(tmp_path / "cache/bodies")).count() == 2 and spark.read.parquet(str(tmp_path / "cache/pages")).count() == 5
    more = frame.unionByName(spark.createDataFrame([("https://a.org/three",)], "url string"))
    again = {r.url: r for r in cache.get(more, counted(tmp_path / "second"), QUICK).collect()}
    assert set(calls(tmp_path / "second")) == {"https://a.org/gone", "https://a.org/dropped", "https://a.org/three"}
    assert {u: r.content for u, r in again.items() if u in got} == {u: r.content for u, r in got.items()} and again[urls[1]].calls == 0
    assert spark.read.parquet(str(tmp_path / "cache/bodies")).count() == 2


def test_papers_of_urls(spark, tmp_path):
    urls = ["https://pmc.ncbi.nlm.nih.gov/articles/PMC12345/", "https://a.org/one", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC7770/", "https://pmc.ncbi.nlm.nih.gov/articles/PMC777"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("asked", fetch.address(F.col("url")))
    got = fetch.fetch(frame, counted(tmp_path / "c"), QUICK)
    assert {r.url: r.error for r in got.collect() if r.error} == {}
    short = fetch.fetch(frame.filter("url like '%PMC12345%'").withColumn("asked", F.lit(fetch.EFETCH + "777")), counted(tmp_path / "d"), QUICK).collect()
    assert [r.error for r in short] == ["no article in the answer"]
    papers = {r.source_url: r for r in fetch.papers_of(got).collect()}
    one, two = papers[urls[0]], papers[urls[1]]
    assert (one.pmcid, one.paper_doi, one.title, one.page_kind) == ("PMC12345", "10.1/j", "Title", "xml")
    assert "GSE12345" in one.candidate_passages and one.candidate_char_count == len(one.candidate_passages)
    assert two.page_kind == "html" and two.paper_id.startswith("a.org_") and "PXD000001" in two.candidate_passages


def test_pages_of_one_address_each_have_a_row(spark, tmp_path):
    from citeloom.plans.queries import fetch_missing

    pages = [(1, "https://a.org/x#top", "one"), (2, "https://a.org/x#top", "two"), (3, "https://a.org/x#top", "three"), (4, "https://a.org/y", "four"), (6, "https://a.org/y", "four")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.url, r.origin) for r in fetch_missing(spark, str(tmp_path)).collect())
    assert got == [("https://a.org/x#top", "cache"), ("https://a.org/x#top", "transport"), ("https://a.org/x#top", "transport"), ("https://a.org/y", "cache"), ("https://a.org/y", "cache")]
