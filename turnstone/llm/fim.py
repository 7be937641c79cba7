"""Fill-in-middle transformation: a document is cut at two places between units and its three parts are put in another order.

One fullmatch of `(unit)*` retains every repetition of the unit: the ends of group 1 are as many as the units, and the two cuts
are two of them, so no text is walked in Python.

Defined results: a null text is an empty one, and empty texts stay plain; a text that holds a marker stays plain, so every
output can be turned back; a null doc_id counts as the empty string in its hash; equal rows give equal rows. Columns of any
names are carried along in a struct of their own, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import column

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Repetitions are possessive: each character fits one unit only, so there is nothing to go back to.
_UNITS = regex.compile(f"({UNIT})*+")
_FIM = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, text: string>"
_ROWS = 256


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32 that depend on the doc_id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(text: str, doc_id: int | None, seed: str = "1") -> dict:
    """The row of one text: number of units, form, code points of prefix and middle, and the output."""
    ends = [0, *_UNITS.fullmatch(text).ends(1)]
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "text": text}
    low, high = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SPM_BELOW:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return {"n": n, "form": form, "prefix_chars": low, "middle_chars": high - low, "text": "".join(parts)}


def transform(documents: DataFrame, seed: str = "1") -> DataFrame:
    """(document, fim) of every row: all columns but the text, and n, form, prefix_chars, middle_chars and the text as put in order."""
    rest = F.struct(*[column(c) for c in documents.columns if c.lower() != "text"])
    given = documents.select(rest.alias("document"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = given.select("document", F.lit(None).cast(_FIM).alias("fim")).schema
    schema = StructType([StructField("document", empty[0].dataType), StructField("fim", empty[1].dataType)])
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                made = pa.array([cut(t.as_py(), i.as_py(), seed) for i, t in zip(part.column(1), part.column(2))], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["document", "fim"])

    return given.mapInArrow(run, schema)


def restored(text: Column, form: Column) -> Column:
    """The text that an output was made of. The outer parts hold no marker, so the first one of each kind is the one that was set."""

    def between(whole: Column, marker: str) -> tuple[Column, Column]:
        at = F.instr(whole, F.lit(marker))
        return F.substring(whole, F.lit(1), at - 1), F.substring(whole, at + len(marker), F.length(whole))

    def parts(second: str) -> tuple[Column, Column, Column]:
        first, rest = between(F.substring(text, F.lit(len(PREFIX) + 1), F.length(text)), second)
        return first, *between(rest, MIDDLE)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(text)


def report(made: DataFrame) -> DataFrame:
    text, form = F.col("fim.text"), F.col("fim.form")
    return made.select(
        "document.doc_id",
        *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(text, 256).alias("output_sha256"),
        F.sha2(restored(text, form), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS b, array_to_string(u[j + 1:n], '') AS z FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE a || b || z END) AS restored_sha256
FROM p
"""
