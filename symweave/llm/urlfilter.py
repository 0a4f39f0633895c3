"""URL filter rules as a sort-merge range join.

A host is keyed by its labels in reverse order, so a rule for a host and its subdomains is the interval of
keys with one prefix. Rules and urls are dealt to key ranges whose bounds come from a bounded sample; a rule
goes to every range that its interval touches. Each range is sorted and swept once, with a stack of the
rules whose intervals are open. A hot host is split over ranges by page id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rows that one key range should hold, ranges at most (beyond, ranges hold more rows, which a sweep streams), and sampled
#: keys per range: at most MOST_RANGES * SAMPLE_PER_RANGE keys, give or take the luck of the draw, reach the driver.
RANGE_ROWS = 200_000
MOST_RANGES = 4_096
SAMPLE_PER_RANGE = 50

#: The rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_key(col):
    """www.example.com -> com.example.www. : the key of each subdomain begins with the key of its host."""
    return F.concat(F.array_join(F.reverse(F.split(col, "\\.")), "."), F.lit("."))


def parse_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path of each url; both empty for a null url or one without ://."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), rest.alias("rest")).select(
        "page_id", ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")
    )


class Sweep:
    """Open rules by host key, each level with its rules by path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def seek(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, action: str) -> None:
        self.seek(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, rules, lengths = self.stack[-1]
        # of rules with one host and path the blocking one stands
        if path not in rules or action == "block":
            rules[path] = (host + path, action)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.seek(key)
        best: tuple[str, str] | None = None
        for _, rules, lengths in reversed(self.stack):
            for n in lengths:
                got = rules.get(path[:n]) if n <= len(path) else None
                if got is not None:
                    if best is None or len(got[0]) > len(best[0]):
                        best = got
                    break
        return best


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    sweep, at = Sweep(), None
    for batch in batches:
        out = []
        for part, key, rank, page, host, path, action in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at:
                sweep, at = Sweep(), part
            if rank == 0:
                sweep.open(key, host, path, action)
            else:
                got = sweep.judge(key, path)
                out.append((page, host, path, got and got[0], got[1] if got else default))
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """pages(page_id, url), rules(action, host, path) -> page_id, host, path, rule, verdict; one row per page row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, the
    longer host among equally long ones, blocking among repeats of one rule. Pages no rule fits get the
    default verdict and a null rule. Null urls have empty hosts and paths. Rules with a null part or an empty
    host are left out. Urls of any length are parsed whole; null page ids are kept. Empty tables are fine; other columns
    are not read.
    """
    spark = pages.sparkSession
    urls = parse_urls(pages).select(host_key(F.col("host")).alias("key"), F.lit(1).alias("rank"), "page_id", "host", "path", F.lit(None).cast("string").alias("action"))
    tie = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))
    n = pages.count()
    parts = min(MOST_RANGES, max(1, -(-n // range_rows)))
    bounds: list[tuple[str, int]] = []
    if parts > 1:
        share = int(min(1.0, parts * SAMPLE_PER_RANGE / n) * (1 << 30)) + 1
        seen = sorted((r["key"], r["tie"]) for r in urls.where(F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(1 << 30)) < share).select("key", tie.alias("tie")).collect())
        bounds = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []
        bounds = sorted(set(bounds))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [bisect_right(bounds, x) for x in zip(b.column(0).to_pylist(), b.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *b.columns[:6]], ["part", "key", "rank", "page_id", "host", "path", "action"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [bisect_right(bounds, (k, -1)) for k in b.column(0).to_pylist()]
            # the interval ends before the prefix's successor: the last character is the dot, the next one is a slash
            high = [bisect_right(bounds, (k[:-1] + "/", -1)) for k in b.column(0).to_pylist()]
            take = pa.array([i for i, (x, y) in enumerate(zip(low, high)) for _ in range(x, y + 1)], pa.int64())
            ids = pa.array([p for x, y in zip(low, high) for p in range(x, y + 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(c.take(take) for c in b.columns)], ["part", "key", "rank", "page_id", "host", "path", "action"])

    schema = "part long, key string, rank int, page_id long, host string, path string, action string"
    clean = rules.where("action is not null and path is not null and host is not null and host <> ''").select("action", ascii_lower(F.col("host")).alias("host"), "path")
    ruled = clean.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("page_id"), "host", "path", "action")
    both = urls.withColumn("tie", tie).mapInArrow(place, schema).unionByName(ruled.mapInArrow(spread, schema))
    swept = both.repartition("part").sortWithinPartitions("part", "key", "rank")
    return swept.mapInArrow(lambda b: _sweep(b, default), "page_id long, host string, path string, rule string, verdict string")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


ORACLE = r"""
WITH t AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.action,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""
