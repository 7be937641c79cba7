"""Similarity graph of a sample: nearest neighbours, spanning forest, bridges between projects and gaps.

The sample is bounded (SAMPLE at most), as the feature asks for; all that follows is as small as the sample. forest_of_any() has no
such bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnstone.functions import text as t
from turnstone.operators.retrieval import neighbours
from turnstone.operators.store import dual_read
from turnstone.sources.shared import written

SAMPLE = 500


def sample(points: DataFrame, n: int) -> DataFrame:
    """The n points that come first by a digest of their id; at most SAMPLE."""
    if n > SAMPLE:
        raise ValueError(f"a sample has at most {SAMPLE} points")
    return points.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(n)


def pairs(points: DataFrame, per_point: int) -> DataFrame:
    """(a, b, score), a < b: each point's nearest others, each pair once."""
    found = neighbours(points, points.select(F.col("id").alias("query_id"), "vec"), per_point)
    return found.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def weighed(edges: DataFrame) -> DataFrame:
    """(a, b, weight): weight = max(0, 1 - score), rounded."""
    return edges.select("a", "b", F.round(F.greatest(F.lit(0.0), 1 - F.col("score")), 6).alias("weight"))


def forest_of_any(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of the minimum spanning forest of a graph of any size; the same edges as spanning_forest().

    Each round, every component takes the first edge by (weight, a, b) that leaves it, and components that such edges join become one;
    so their number halves at least. Names of components run along the taken edges to their least one by doubled steps. All is joins
    and minima over tables in the shared folder, and edges within a component are dropped as they arise.
    """
    left = written(weighed(edges).filter("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight")).withColumns({"x": F.col("a"), "y": F.col("b")}), "edges")
    forest = None
    while True:
        ends = left.select(F.col("x").alias("c"), F.struct("weight", "a", "b", F.col("y").alias("to")).alias("e")).unionAll(left.select(F.col("y").alias("c"), F.struct("weight", "a", "b", F.col("x").alias("to")).alias("e")))
        taken = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"), "taken")
        if taken.isEmpty():
            break
        own = taken.select("a", "b", "weight").distinct()
        forest = own if forest is None else forest.unionAll(own)
        # Taken edges form trees but for one pair in each that took the same edge from both sides; its smaller end is the root.
        back = taken.select(F.col("c").alias("to"), F.col("to").alias("c2"))
        up = written(taken.join(back, "to").select("c", F.when((F.col("c2") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")), "up")
        while True:
            above = up.select(F.col("c").alias("up"), F.col("up").alias("above"))
            higher = written(up.join(above, "up").select("c", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved")), "up")
            up = higher.select("c", "up")
            if higher.filter("moved").isEmpty():
                break
        of = lambda side: up.select(F.col("c").alias(side), F.col("up").alias(f"{side}2"))
        left = written(left.join(of("x"), "x").join(of("y"), "y").filter("x2 <> y2").select("a", "b", "weight", F.col("x2").alias("x"), F.col("y2").alias("y")), "edges")
    return left.select("a", "b", "weight") if forest is None else forest


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of the minimum spanning forest of a sample; weight = max(0, 1 - score), ties by (weight, a, b).

    An edge that is not in the forest of some part of the edges is in no forest of all of them, so each part's forest is found
    where it lies, and only those edges, fewer than nodes times parts, meet in one task. The sample bounds the nodes.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((w, a, b) for batch in batches for a, b, w in zip(*(c.to_pylist() for c in batch.columns)))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for w, a, b in rows:
            if find(a) != find(b):
                root[find(a)] = find(b)
                kept.append((a, b, w))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "weight"])

    schema = "a bigint, b bigint, weight double"
    return weighed(edges).mapInArrow(forest, schema).coalesce(1).mapInArrow(forest, schema)


def bridges(forest: DataFrame, points: DataFrame) -> DataFrame:
    """(project, partner, n): forest edges between two different named projects, counted from both sides."""
    p = points.select(F.col("id"), F.col("project").cast("string").alias("project"))
    ends = forest.join(p.select(F.col("id").alias("a"), F.col("project").alias("pa")), "a").join(p.select(F.col("id").alias("b"), F.col("project").alias("pb")), "b").filter("pa <> pb and pa <> '' and pb <> ''")
    return ends.select(F.col("pa").alias("project"), F.col("pb").alias("partner")).unionAll(ends.select("pb", "pa")).groupBy("project", "partner").agg(F.count(F.lit(1)).alias("n"))


def isolated(forest: DataFrame, points: DataFrame) -> DataFrame:
    """Named projects of two or more sessions that no bridge touches."""
    sizes = points.filter("project <> ''").groupBy(F.col("project").cast("string").alias("project")).agg(F.count(F.lit(1)).alias("sessions")).filter("sessions >= 2")
    return sizes.join(bridges(forest, points), "project", "left_anti")


def near_misses(edges: DataFrame, forest: DataFrame, points: DataFrame, at_least: float = 0.5, most: int = 5) -> DataFrame:
    """Pairs of projects that are alike on average, but that no forest edge connects."""
    p = points.select("id", F.col("project").cast("string").alias("project"))

    def by_project(e: DataFrame) -> DataFrame:
        j = e.join(p.select(F.col("id").alias("a"), F.col("project").alias("pa")), "a").join(p.select(F.col("id").alias("b"), F.col("project").alias("pb")), "b").filter("pa <> pb")
        return j.withColumn("x", F.least("pa", "pb")).withColumn("y", F.greatest("pa", "pb"))

    mean = by_project(edges).groupBy("x", "y").agg(F.round(F.avg("score"), 6).alias("score")).filter(F.col("score") >= at_least)
    return mean.join(by_project(forest).select("x", "y").distinct(), ["x", "y"], "left_anti").orderBy(F.desc("score"), "x", "y").limit(most)


def node_detail(nodes: DataFrame, newer: DataFrame, older: DataFrame) -> DataFrame:
    """What is stored of each node (column id), from the newer points or else the older ones, the oldest start first. Few nodes, as many as the sample."""
    own = nodes.select("id").distinct()
    return dual_read(newer.join(F.broadcast(own), "id", "left_semi"), older.join(F.broadcast(own), "id", "left_semi"), "id").orderBy(F.asc_nulls_last("start_ts"), "id")


def _top(counted: DataFrame, value: str, most: int) -> DataFrame:
    w = Window.partitionBy("project").orderBy(F.desc("n"), value)
    return counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)


def insights(points: DataFrame, calls: DataFrame, forest: DataFrame) -> DataFrame:
    """By project: sessions, sessions with errors, its theme, a label of the theme and the three most used tools, the four most used
    tools, the three folders most worked in, bridges and partners. calls: session_id, name and, if they have it, input_json."""
    named = points.select(F.col("id").alias("session_id"), F.col("project").cast("string").alias("project"), "has_errors").filter("project <> ''")
    base = named.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.count_if("has_errors").alias("with_errors"))
    own = calls.join(named.select("session_id", "project"), "session_id")
    tools = _top(own.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n")), "name", 4)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("r", "name", "n"))), lambda s: F.concat(s["name"], F.lit("×"), s["n"].cast("string")))
    tools = tools.groupBy("project").agg(shown.alias("shown"), F.collect_set("name").alias("names"))
    if "input_json" in calls.columns:
        file = F.get_json_object("input_json", "$.file_path")
        folder = t.bucket_path(F.regexp_extract(file, r"^(.*)/[^/]*$", 1))
        folders = _top(own.filter(F.contains(file, F.lit("/"))).groupBy("project", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")), "folder", 3)
        folders = folders.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "folder"))), lambda s: s["folder"]).alias("folders"))
    else:
        folders = base.select("project", F.array().cast("array<string>").alias("folders"))
    out = bridges(forest, points).groupBy("project").agg(F.sum("n").alias("bridges_out"), F.array_join(F.array_sort(F.collect_set("partner")), ",").alias("partners"))
    joined = base.join(tools, "project", "left").join(folders, "project", "left").join(out, "project", "left").withColumn("theme", t.theme(F.coalesce("names", F.array().cast("array<string>"))))
    label = F.when(F.size("shown") > 0, F.concat("theme", F.lit(" · "), F.array_join(F.slice("shown", 1, 3), " "))).otherwise(F.col("theme"))
    return joined.select("project", "sessions", "with_errors", "theme", label.alias("label"), F.array_join(F.coalesce("shown", F.array().cast("array<string>")), " ").alias("tools"), F.array_join(F.coalesce("folders", F.array().cast("array<string>")), " ").alias("folders"), F.coalesce("bridges_out", F.lit(0)).alias("bridges_out"), F.coalesce("partners", F.lit("")).alias("partners"))
