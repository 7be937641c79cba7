"""Line deduplication: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble by position.

Defined results: a null or empty text is one empty line; empty keys are never dropped; each row of documents counts as one
document, so a repeated row counts again and loses the same lines; a null doc_id is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, column, free_names, materialize

MIN_DOCUMENTS = 10
MIN_KEY_CHARS = 1
SALTS, HEAVY_SHARE, HEAVY_LEAST = 64, 1e-3, 1_000
_SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), UPPER, LOWER)


def _hashed(keys: Column) -> list[Column]:
    """Two independent 64-bit hashes, so that keys of a very large corpus don't meet by chance."""
    return [F.xxhash64(keys).alias("h1"), F.xxhash64(F.lit(8), keys).alias("h2")]


def frequent_keys(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(h1, h2, n) of the keys found in at least min_documents rows. Each row's keys are made distinct before they are counted."""
    keys = documents.select(F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_key))).alias("key")).filter(F.length("key") >= min_key_chars)
    return keys.select(*_hashed(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents)


def drop_frequent_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """All columns of documents, with the kept text, and behind them n_lines before dropping and n_dropped, under free names if documents has such columns.

    Only hashes and positions are joined to the frequent keys; texts move once, to meet the positions that they lose. Keys with a
    large share of all frequent lines (at most 1 / HEAVY_SHARE keys) are dealt over salts, for which their rows are copied.
    """
    row = F.xxhash64("doc_id", "text")
    placed = documents.select(F.col("doc_id").alias("_doc"), row.alias("_row"), F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
    placed = placed.select("_doc", "_row", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= min_key_chars).select("_doc", "_row", "_pos", *_hashed(F.col("_key")))
    frequent = materialize(frequent_keys(documents, min_documents, min_key_chars), "lines")
    heavy = max(HEAVY_LEAST, HEAVY_SHARE * (frequent.agg(F.sum("n")).first()[0] or 0))
    hot = [r[0] for r in frequent.filter(F.col("n") >= heavy).select("h1").collect()]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    dealt = placed.withColumn("_salt", F.when(is_hot, F.pmod("_row", F.lit(SALTS)).cast("int")).otherwise(0))
    keys = frequent.select("h1", "h2", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    gone = dealt.join(keys, ["h1", "h2", "_salt"], "left_semi").groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_gone"))
    # The row's own columns stay together, so none of any name can meet those here.
    given = documents.select(F.struct(*[column(c) for c in documents.columns]).alias("_given"), F.col("doc_id").alias("_its"), row.alias("_own"))
    joined = given.join(gone, F.col("_its").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_row")), "left")
    own = F.col("_given.text")
    lines = lines_of(own)
    # One struct is bound per row, so that the text is split once and each kept line is read by its place.
    bound = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")).alias("keep")))
    kept = F.element_at(F.transform(bound, lambda s: F.array_join(F.transform(s["keep"], lambda i: s["lines"][i]), "\n")), 1)
    text = F.when(F.col("_gone").isNull(), F.coalesce(own, F.lit(""))).otherwise(kept)
    dropped = F.coalesce(F.size("_gone"), F.lit(0))
    names = free_names(documents.columns, "n_lines", "n_dropped")
    return joined.select(
        *[text.alias(c) if c.lower() == "text" else F.col("_given").getField(c).alias(c) for c in documents.columns],
        F.size(lines).cast("bigint").alias(names[0]),
        F.when(F.col("_gone").isNull(), 0).otherwise(dropped).cast("bigint").alias(names[1]),
    )


def report(kept: DataFrame) -> DataFrame:
    n_lines, n_dropped = map(column, kept.columns[-2:])
    return kept.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT rowid AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), e AS (
  SELECT r, pos, lines[pos] AS line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS pos FROM l)
), f AS (
  SELECT k FROM e WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), g AS (
  SELECT e.r, count(*) AS n_lines, count(f.k) AS n_dropped, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE f.k IS NULL), '') AS kept
  FROM e LEFT JOIN f ON e.k = f.k GROUP BY e.r
)
SELECT l.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM l JOIN g ON l.r = g.r
"""
