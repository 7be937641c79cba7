"""The corpus pipeline: toxic documents go, frequent lines go, one of each group of near copies stays, contaminated documents go, and what is left is packed.

Each stage takes what its predecessor kept, as it was written; all but the last return the columns of documents. Toxicity learns
from the labels of the table, and decontamination searches for the table's benchmark; both lie beside the documents in sf_dir.

Every stage judges rows by their own text: a doc_id may be null or repeat, columns of any other names are carried along, a null text
counts as an empty one, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import decontam, line_dedup, minhash, packing, simhash, toxicity
from turnstone.llm.common import column, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted as toxic go. A row without text is judged as a usual clean one, equal texts alike; without labels none goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("predicted = 0").select("given.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten rows or more go from all of them; a repeated row counts again. Rows stay, if need be with an empty text; a null text becomes an empty one."""
    return line_dedup.drop_frequent_lines(docs).select([column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: that of the smallest doc_id, null last, among equal ones the smallest by text. Rows
    without words are copies of each other. Links are those of SimHash fingerprints, as op10 has them, and those of shingle sets that
    are alike enough, which also finds copies whose fingerprints lie further apart."""
    return simhash.first_of_each(docs, simhash.united(minhash.roots(docs), simhash.roots(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark go, repeated ones all alike; a null item_id is an item like any other, an item without words has no passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's ids; a row without text has one of the end id alone, a repeated row its pieces again."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: A trained model and a tokenizer take part, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
