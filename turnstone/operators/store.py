"""Writing and reading the point store: replace by key, first of each key, dual reads, versioned updates, migration, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstone.functions import text as t

SCHEMA_VERSION = (3, 0)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; an aggregate, so a key with very many rows is reduced before it is shuffled."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def index_report(rows: DataFrame, key: str) -> DataFrame:
    """(indexed, duplicates_skipped) of a batch of rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("indexed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_skipped"))


def batch_report(rows: DataFrame, batch: str, failed: str) -> DataFrame:
    """(batch, indexed, errors): all rows of a batch count as errors if the condition `failed` holds for one of them; failed rows are
    what a batch that is written again leaves out."""
    bad = F.max(F.coalesce(F.expr(failed), F.lit(False)))
    n = F.count(F.lit(1))
    return rows.groupBy(F.col(batch).alias("batch")).agg(F.when(bad, F.lit(0)).otherwise(n).cast("bigint").alias("indexed"), F.when(bad, n).otherwise(F.lit(0)).cast("bigint").alias("errors"))


def quarantined(rows: DataFrame, failed: str) -> tuple[DataFrame, DataFrame]:
    """What can be written, and what cannot."""
    bad = F.coalesce(F.expr(failed), F.lit(False))
    return rows.filter(~bad), rows.filter(bad)


def by_point_id(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """The sessions whose point ids (version 5 UUIDs of their ids) are asked for (column point_id), found by those alone."""
    return sessions.withColumn("point_id", t.uuid5_dns(F.col("session_id").cast("string"))).join(asked.select("point_id").distinct(), "point_id", "left_semi")


def turn_at(turns: DataFrame, session_id, index: int) -> DataFrame:
    """One turn of a session; an error where the session has no such turn."""
    own = turns.filter(F.col("session_id") == session_id)
    found = own.filter(F.col("turn_index") == index)
    if index < 0 or found.isEmpty():
        raise IndexError(f"session {session_id} has no turn {index}; it has {own.count()}")
    return found


def of_project(sessions: DataFrame, path: str, indexed: DataFrame | None = None, as_of: Column | None = None, wait_seconds: int = 90) -> DataFrame:
    """The sessions of exactly that project path, to be indexed again; nothing if the path was indexed within the wait. indexed: project_path, at."""
    own = sessions.filter(F.col("project_path") == path)
    if indexed is None:
        return own
    recent = indexed.filter((F.col("project_path") == path) & (F.unix_timestamp(F.col("at").cast("timestamp")) > F.unix_timestamp(as_of.cast("timestamp")) - wait_seconds))
    return own.join(recent.select("project_path").distinct(), "project_path", "left_anti")


def info(points: DataFrame, by: str) -> DataFrame:
    """(name, n): rows in all (name null) and by value of a column."""
    return points.groupBy(F.col(by).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionAll(points.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("name"), "n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key isn't new, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def dual_read(newer: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """Rows of the newer schema, and of the older where the newer has none."""
    return newer.unionByName(older.join(newer.select(key), key, "left_anti"), allowMissingColumns=True)


def update_where(points: DataFrame, ids: list, below_version: int, values: dict[str, object], key: str = "id") -> DataFrame:
    """New values for the given ids whose schema_version is below the given one."""
    hit = F.col(key).isin(ids) & (F.col("schema_version") < below_version)
    return points.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def migrate(old: DataFrame, new: DataFrame | None) -> DataFrame:
    """Version 2 points as version 3: start_iso becomes a time, enrichment stays null. A target that holds rows is left as it is."""
    if new is not None and not new.isEmpty():
        return new
    lifted = old.filter(F.col("session_id").isNotNull() & (F.col("session_id") != ""))
    return lifted.withColumn("start_ts", F.try_to_timestamp("start_iso")).withColumn("schema_version", F.lit(SCHEMA_VERSION[0])).withColumns({c: F.lit(None).cast("string") for c in ("intent", "outcome", "arc", "topic")})


def check_path(path: str, root: str, suffix: str = ".snapshot") -> str:
    """A snapshot's path under root: no empty path, no NUL, no step up, the right suffix."""
    import posixpath

    if not path or "\0" in path or ".." in path.split("/") or not path.endswith(suffix):
        raise ValueError(f"not a snapshot path: {path!r}")
    full = posixpath.normpath(path if path.startswith("/") else f"{root}/{path}")
    if full != root and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path!r} lies outside {root!r}")
    return full


def check_inside(path: str, roots: list[str]) -> str:
    """The path with all links followed, if it lies under one of the roots; else an error. For local folders."""
    import os

    if not path or "\0" in path:
        raise ValueError(f"not a path: {path!r}")
    full = os.path.realpath(path, strict=True)
    if not any(os.path.commonpath([full, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise ValueError(f"{path!r} lies outside all roots")
    return full


def write_replacing(new: DataFrame, path: str, key: str) -> None:
    """Replace by key: what is at path, without the keys of new, and new are written to a folder beside it and then become visible at
    once, as the one that the file `current` names. A reader sees the old rows or the new ones."""
    import uuid

    spark = new.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    old = read_current(spark, path)
    (new if old is None else upsert(old, new, key)).write.parquet(f"{path}/{name}")
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        name = spark.read.text(f"{path}/current").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.parquet(f"{path}/{name}")


def export_snapshot(points: DataFrame, path: str) -> None:
    """The rows as Parquet, with a manifest of their count, version and a SHA-256 that doesn't depend on their order. Refuses a path that exists."""
    spark = points.sparkSession
    points.write.mode("errorifexists").parquet(f"{path}/data")
    manifest = json.dumps({"version": SCHEMA_VERSION, "schema": points.schema.jsonValue(), **_digest(spark.read.parquet(f"{path}/data"))})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def _digest(df: DataFrame) -> dict:
    """Number of rows and a SHA-256 over them, whatever their order: of the sums of rows' SHA-256 by their first three hex digits."""
    own = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(own, i * 15 + 1, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.groupBy(F.substring(own, 1, 3).alias("at")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    line = F.concat_ws(":", "at", "n", *[f"s{i}" for i in range(4)])
    row = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("hash")).first()
    return {"rows": row["rows"], "hash": row["hash"]}


def import_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The rows and warnings. Another major version or other rows than signed are errors; other minor versions or schemas, or no manifest, are warnings."""
    df = spark.read.parquet(f"{path}/data")
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return df, ["no signature"]
    warnings = []
    if manifest["version"][0] != SCHEMA_VERSION[0]:
        raise ValueError(f"snapshot of version {manifest['version']}, this is {SCHEMA_VERSION}")
    if manifest["schema"] != df.schema.jsonValue():
        warnings.append("schema differs")
    if manifest["version"][1] != SCHEMA_VERSION[1]:
        warnings.append("minor version differs")
    if {k: manifest[k] for k in ("rows", "hash")} != _digest(df):
        raise ValueError("the rows are not those that were signed")
    return df, warnings
