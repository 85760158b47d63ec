"""Code that may fail, for each group of rows: an error is a row of its own, and the other groups' results stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[pd.DataFrame], dict[str, float]]


def attempted(rows: DataFrame, key: str, stages: dict[str, Stage], extras: dict[str, Stage] | None = None, most: int = 500) -> DataFrame:
    """(key, metrics, error, stage, notes) of each group: what its stages measured, or what went wrong where.

    ``stages`` run in turn on the group's rows; their metrics are merged, later ones winning. The first that
    raises ends its group: null metrics, with the error's kind and text (``most`` characters) and the stage's name. ``extras`` then run on groups
    that came through, and are merged too; one that raises leaves the rest as it is, and is told in ``notes``. A null key is a group.
    """
    key_type = rows.schema[key].dataType.simpleString()

    def told(e: Exception) -> str:
        return f"{type(e).__name__}: {e}"[:most]

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        metrics, error, at, notes = {}, None, None, {}
        for name, stage in stages.items():
            try:
                metrics |= {m: float(v) for m, v in stage(g).items()}
            except Exception as e:
                metrics, error, at = None, told(e), name
                break
        for name, stage in (extras or {}).items() if error is None else ():
            try:
                metrics |= {m: float(v) for m, v in stage(g).items()}
            except Exception as e:
                notes[name] = told(e)
        own = [None if k[0] is None or pd.isna(k[0]) else k[0]]
        return pd.DataFrame({key: pd.Series(own, dtype=object), "metrics": [metrics], "error": [error], "stage": [at], "notes": [notes]})

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {key_type}, metrics map<string,double>, error string, stage string, notes map<string,string>")


def first_that_works(rows: DataFrame, schema: str, ways: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], out: str = "way") -> DataFrame:
    """Rows of ``schema`` from the first of several ways that doesn't raise, batch by batch, with its name in ``out``.

    If none works, the last one's error ends the job: there is nothing to fall back on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, (name, way) in enumerate(ways.items()):
                try:
                    yield way(batch).assign(**{out: name})
                    break
                except Exception:
                    if i == len(ways) - 1:
                        raise

    return rows.mapInPandas(run, f"{schema}, `{out}` string")


def failures(done: DataFrame, key: str) -> DataFrame:
    """(key, stage, error) of the groups that failed, and (extra, note) of those that lack an extra."""
    ended = done.where("error IS NOT NULL").select(key, "stage", "error")
    return ended.unionByName(done.select(key, F.explode("notes").alias("stage", "error")))
