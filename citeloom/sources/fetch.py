"""Papers from URLs: a paced fetch with back-off, a content-addressed cache, and records of what came.

The network is an injected transport, transport(url) -> Response, which is sent
to the tasks that call it. Tasks share a rate by taking equal parts of it. What
succeeded goes into a cache of two tables: pages (url, digest, content_type) and
bodies (digest, content), a body once however many URLs lead to it. A rerun
takes from the cache what is there, by a join, and calls the transport for the
rest only. Failures are rows with the reason; they are not cached, so a rerun
tries them again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.candidates import select_passages
from citeloom.operators.sections import parse_documents
from citeloom.session import exists, reach_workers

#: Where JATS documents are asked for by PMCID (a fixed value of that service).
EFETCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pmc&rettype=xml&id="
PAGES, BODIES = "url string, digest string, content_type string", "digest string, content string"
FETCHED = "url string, asked string, content string, content_type string, error string, calls int"


class Response(NamedTuple):
    status: int
    body: str = ""
    content_type: str = ""
    #: Seconds that the server asks to wait, if it does.
    retry_after: float | None = None


Transport = Callable[[str], Response]


@dataclass
class Bucket:
    """Tokens that fill up at a rate; take() waits for one."""

    rate: float
    burst: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    held: float = field(init=False)
    seen: float = field(init=False)

    def __post_init__(self) -> None:
        self.held, self.seen = self.burst, self.clock()

    def take(self) -> None:
        now = self.clock()
        self.held = min(self.burst, self.held + (now - self.seen) * self.rate)
        self.seen = now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.seen, self.held = self.clock(), 1.0
        self.held -= 1


@dataclass(frozen=True)
class Policy:
    """How a fetch behaves. rate: calls a second of all tasks together; tasks: how many call at once."""

    rate: float = 3.0
    tasks: int = 3
    tries: int = 5
    first_wait: float = 1.0
    longest_wait: float = 60.0

    def wait(self, attempt: int, asked: float | None) -> float:
        """Seconds before the next attempt: doubled each time, or what the server asks for if that is more."""
        return min(self.longest_wait, max(self.first_wait * 2**attempt, asked or 0.0))


def call(url: str, transport: Transport, policy: Policy, bucket: Bucket) -> tuple[Response | None, str | None, int]:
    """(response, error, calls): 429, 408, 5xx and broken connections are tried again, other refusals aren't."""
    error = None
    for attempt in range(policy.tries):
        bucket.take()
        asked = None
        try:
            got = transport(url)
        except Exception as e:  # noqa: BLE001 - told in the row
            error = f"{type(e).__name__}: {e}"
        else:
            if 200 <= got.status < 300:
                return got, None, attempt + 1
            error, asked = f"HTTP {got.status}", got.retry_after
            if got.status not in (408, 429) and got.status < 500:
                return None, error, attempt + 1
        if attempt + 1 < policy.tries:
            bucket.sleep(policy.wait(attempt, asked))
    return None, error, policy.tries


def address(url: Column) -> Column:
    """Where a paper is asked for: PMC articles at the service that has them as JATS, all others at their own URL."""
    number = F.regexp_extract(url, r"(?i)(?:^|/)(?:pmc/articles/|articles/|pmc/)PMC(\d{4,})/?", 1)
    return F.when(number != "", F.concat(F.lit(EFETCH), number)).otherwise(url)


def fetch(urls: DataFrame, transport: Transport, policy: Policy | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """FETCHED rows of distinct urls(url, asked); one of content and error is null.

    A JATS answer without an article is an error. The result should be written
    before it is used twice.
    """
    policy = policy or Policy()
    reach_workers(urls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(policy.rate / policy.tasks, sleep=sleep)
        for batch in batches:
            out = []
            for url, asked in zip(batch.column("url").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                got, error, calls = call(asked, transport, policy, bucket)
                if got is not None and asked.startswith(EFETCH) and "<article" not in got.body:
                    got, error = None, "no article in the answer"
                out.append((url, asked, got and got.body, got and got.content_type, error, calls))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.string()) for i, c in enumerate(zip(*out, strict=True))], [f.split()[0] for f in FETCHED.split(", ")])

    return urls.select("url", "asked").repartition(policy.tasks).mapInArrow(run, FETCHED)


def with_known(urls: DataFrame, known: DataFrame, get: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url, content, content_type, error, calls) of distinct urls(url): those in known(url, content, content_type), and get() of the others."""
    wanted = urls.select("url").filter("url is not null").distinct()
    had = wanted.join(known, "url").select("url", "content", "content_type", F.lit(None).cast("string").alias("error"), F.lit(0).alias("calls"))
    lacking = wanted.join(known.select("url"), "url", "left_anti").withColumn("asked", address(F.col("url")))
    return had.unionByName(get(lacking).select("url", "content", "content_type", "error", "calls"))


class Cache:
    """Fetched pages below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        at = f"{self.folder}/{table}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        """(url, content, content_type) of all pages; of a URL that was fetched more than once one page."""
        pages = self._read("pages", PAGES).groupBy("url").agg(F.min(F.struct("digest", "content_type")).alias("p"))
        return pages.select("url", "p.*").join(self._read("bodies", BODIES).dropDuplicates(["digest"]), "digest").select("url", "content", "content_type")

    def add(self, fetched: DataFrame) -> None:
        """Append pages (url, content, content_type). Bodies go first: what an interrupted run leaves is a body that nothing names."""
        new = fetched.filter("content is not null").withColumn("digest", F.sha2("content", 256))
        bodies = new.select("digest", "content").dropDuplicates(["digest"]).join(self._read("bodies", "digest string"), "digest", "left_anti")
        bodies.write.mode("append").parquet(f"{self.folder}/bodies")
        new.select("url", "digest", "content_type").write.mode("append").parquet(f"{self.folder}/pages")

    def get(self, urls: DataFrame, transport: Transport, policy: Policy | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """with_known() over this cache; what is fetched is written first, and then read. A result holds until the next get()."""

        def missing(lacking: DataFrame) -> DataFrame:
            at = f"{self.folder}/answers"
            fetch(lacking, transport, policy, sleep).write.mode("overwrite").parquet(at)
            answers = self.spark.read.schema(FETCHED).parquet(at)
            self.add(answers)
            return answers

        return with_known(urls, self.known(), missing)


def is_xml(content: Column, content_type: Column) -> Column:
    head = F.lower(F.left(F.ltrim(content), F.lit(500)))
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("xml")) | head.startswith("<?xml") | F.contains(head, F.lit("<article"))


def papers_of(fetched: DataFrame) -> DataFrame:
    """Papers with passages, source_url and page_kind (xml, html) of fetched(url, content, content_type, ...); failures have none.

    Without an id of its own a paper is named by the PMCID of its URL, else by
    its host and a hash of its URL.
    """
    url = F.col("url")
    pmcid = F.nullif(F.upper(F.regexp_extract(url, r"(?i)PMC\d{4,}", 0)), F.lit(""))
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^\w+://([^/:]+)", 1), F.lit("")), F.lit("remote"))
    own = F.coalesce(pmcid, F.concat_ws("_", host, F.pmod(F.xxhash64(url), F.lit(10**8)).cast("string")))
    kind = F.when(is_xml(F.col("content"), F.col("content_type")), "xml").otherwise("html")
    raw = fetched.filter("content is not null").select("content", own.alias("paper_id"), url.alias("source_path"), url.alias("source_url"), kind.alias("page_kind"), pmcid.alias("url_pmcid"))
    papers = parse_documents(raw, keep=("source_url", "page_kind", "url_pmcid"))
    return select_passages(papers.withColumn("pmcid", F.coalesce(F.nullif("pmcid", F.lit("")), "url_pmcid", F.lit(""))).drop("url_pmcid"))
