"""From documents to token files: toxic, near-duplicate and contaminated documents go, sources are mixed, ids are written.

Every stage knows a row by its id and text: ids may be null or stand over several texts. A null text
is an empty one; other columns than id, text and source are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import cube_mix, ngram_join, tiling_decontam, token_output, toxicity
from reelspark.llm._store import materialize
from reelspark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text isn't predicted toxic; empty texts stay, repeated rows share their fate."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id; repeated rows stay once, empty texts are near to nothing."""
    return ngram_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of whose text no tiles cover half of a benchmark item; empty texts and items match nothing."""
    return tiling_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times; a null source is a source of its own; draws agree between runs."""
    return cube_mix.apply(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of ids (null first), read back: doc_id, start, n_tokens, ids_crc32 of each row."""
    return token_output.read_tokens(token_output.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: The fit of the first stage, the draws of the mix and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all of what the one before kept, written as Parquet and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
