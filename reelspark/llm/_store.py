"""Tables and files in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise: rows may be long.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Stands for a null identifier inside the operators, so that joins keep such rows.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark runs in one process.

    What the operators write there is read when their results are; the folder may be emptied after that.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reelspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def id_key(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def id_value(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(c, F.lit(NULL_ID))


def text_hash(text: Column) -> Column:
    """With the id it names a row: rows that share both have one text, so what holds for one holds for the other."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, body, text) only: other columns can't clash; a null text is empty.

    A row is (key, body), never the id alone: ids may be null or stand over several texts. No state
    is kept for it, so a task that runs again gives its rows the same names.
    """
    bound_batches(docs.sparkSession)
    return docs.select(id_key(docs[id_col]).alias("key"), text_hash(docs[text_col]).alias("body"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with each row's key and body, in columns whose names clash with none of its own."""
    key, body = unused(docs, "row_key"), unused(docs, "row_body")
    return docs.select("*", id_key(docs[id_col]).alias(key), text_hash(docs[text_col]).alias(body)), key, body


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't in ``gone`` (key, body)."""
    named, key, body = with_names(docs, id_col, text_col)
    g = gone.select(F.col("key").alias("gone_key"), F.col("body").alias("gone_body")).distinct()
    out = named.join(g, (named[key] == g["gone_key"]) & (named[body] == g["gone_body"]), "left_anti")
    return out.select(*[out[c] for c in docs.columns])
