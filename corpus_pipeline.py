"""Corpus pipeline over documents: toxicity filter, exact dedup, SimHash near-dedup, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each stage's rows as Parquet in the shared folder and gives them to the next. Stages handle what their operators
do: null, empty and very long texts, repeated rows, empty tables and extra columns, which all but the last stage keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofledger.llm import exact, mixing, pieces, similar, toxicity
from asofledger.llm.common import materialize, table
from asofledger.llm.queries import tokenizer_file

#: How often the mixture may repeat a small source; every source is passed once at least, so no document is lost.
MAX_EPOCHS = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score below the toxicity threshold, learnt from the labels of docs. Null and empty texts score as the bias says, repeated rows alike, and no rows give none."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (white space runs count as one space): that of the smallest doc_id."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that a similarity of 0.8 or more of their five-word shingles connects, found by SimHash and verified on the shingles: that of the smallest doc_id. Null and empty texts are one group, a null doc_id comes last, and no rows give none."""
    return similar.keep_dissimilar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's temperature weight says: once, or once more in small sources. Null text has no tokens, a null source is a source, rows that share a doc_id go together, and no rows give none."""
    return mixing.mix(docs, max_epochs=MAX_EPOCHS).select(*[f"`{c}`" for c in docs.columns])


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the decoded text's SHA-256 of each row. Null text is empty and has the begin and end ids; repeated rows give a row each, and no rows give none."""
    return pieces.round_trip(docs, tokenizer_file(), keep=["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", to_pieces)]

#: Learnt weights, SimHash components and SentencePiece ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
