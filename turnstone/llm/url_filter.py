"""URL filters by a sort-merge range join.

A host's labels, reversed and each ended by a low character, make a canonical key under which a rule's host and all its
subdomains are one interval: the keys that start with the rule's. Pages and rules are cut into the same key ranges (a rule goes
to each range that its interval meets), sorted by key, and swept once: a stack holds the hosts whose intervals contain the
current key, nested inside each other, each with its paths. A page goes down the stack, and at each host looks up its own path's
prefixes of the lengths that the host's rules have, the longest first.

Pages are cut at (key, page hash), so a host with most of the pages still spreads over many ranges. The cuts come from a bounded
sample, found by binary search; they steer only how evenly the work is spread.

Defined results: a null url, or one without `://`, has an empty host and path and meets no rule; among rules that fit, the one
with the longest host wins, then the longest path, then block before allow; a page without a rule gets the default verdict;
a null page_id stays null.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
CUT_SAMPLE = 4_096
END = "\x01"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_substr(_after(url), F.lit(r"^[^/?#]*")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_substr(F.regexp_replace(_after(url), r"^[^/?#]*", ""), F.lit(r"^[^?#]*"))


def _after(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def canonical(host: Column) -> Column:
    """The host's labels in reverse, each ended by a low character; empty for an empty host."""
    return F.when(F.length(host) > 0, F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), END), F.lit(END))).otherwise("")


def rules_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


class _Host:
    """The rules of one host: their verdicts by path, block before allow, and the lengths of the paths, the longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.verdicts: dict[str, str] = {}
        self.sizes: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.verdicts.get(path) != "block":
            self.verdicts[path] = verdict
        if len(path) not in self.sizes:
            self.sizes = sorted([*self.sizes, len(path)], reverse=True)

    def find(self, path: str) -> tuple[str, str] | None:
        for n in self.sizes:
            own = path[:n]
            if len(own) == n and own in self.verdicts:
                return self.host + own, self.verdicts[own]
        return None


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages."""
    spark = pages.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url")
    left = pages.select(F.col("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    left = left.withColumn("key", canonical(F.col("host"))).withColumn("salt", F.lpad(F.hex(F.xxhash64("page_id", "path")), 16, "0"))
    # Twenty rows of the sample, two strings each, for each range.
    sample = sorted(((r[0].encode(), r[1].encode()) for r in left.select("key", "salt").orderBy(F.xxhash64("salt", "key"), "salt", "key").limit(max(CUT_SAMPLE, 20 * parts)).toLocalIterator()))
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many cuts lie at or before (key, salt): the range of a page, or with a second pair the last range of a rule."""
        for batch in batches:
            at = [[bisect_right(cuts, (k.encode(), s.encode())) for k, s in zip(batch.column(i).to_pylist(), batch.column(i + 1).to_pylist())] for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), *batch.columns[4:]], ["part", "last", *batch.schema.names[4:]])

    def placed(df: DataFrame, low: Column, low_salt: Column, high: Column, high_salt: Column, keep: list[str]) -> DataFrame:
        kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
        return df.select(low.alias("a"), low_salt.alias("b"), high.alias("c"), high_salt.alias("d"), *keep).mapInArrow(place, f"part int, last int, {kinds}")

    key, salt, none, end = F.col("key"), F.col("salt"), F.lit(""), F.lit("\U0010ffff")
    columns = ["key", "kind", "salt", "host", "path", "verdict", "page_id"]
    ruled = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null and verdict is not null")
    ruled = ruled.select(canonical(F.col("host")).alias("key"), F.lit(0).alias("kind"), none.alias("salt"), "host", "path", "verdict", F.lit(None).cast(left.schema["page_id"].dataType).alias("page_id"))
    ruled = placed(ruled, key, none, F.concat(key, end), end, columns).withColumn("part", F.explode(F.sequence("part", "last")))
    paged = placed(left.select("key", F.lit(1).alias("kind"), "salt", "host", "path", F.lit(None).cast("string").alias("verdict"), "page_id"), key, salt, key, salt, columns)
    both = ruled.select("part", *columns).unionByName(paged.select("part", *columns))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            out: list[tuple[str | None, str]] = []
            keep: list[int] = []
            for i, (p, key, kind, host, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict")))):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1].key != key:
                        stack.append(_Host(key, host))
                    stack[-1].add(path, verdict)
                    continue
                out.append(next((found for h in reversed(stack) if h.key and (found := h.find(path))), (None, default)))
                keep.append(i)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("host"), rows.column("path"), pa.array([r for r, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    schema = f"page_id {left.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, schema)


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
