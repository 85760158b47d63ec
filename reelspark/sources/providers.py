"""What needs pixels or weights stays outside: a provider turns rows of images into columns, Spark does the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from reelspark.functions.names import Named


@dataclass(frozen=True)
class Provider:
    """``run`` maps a batch of rows to rows of ``schema``; errors of a batch are its to turn into rows."""

    run: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str


PROVIDERS: Named[Provider] = Named("provider")


def apply(rows: DataFrame, name: str) -> DataFrame:
    """Runs a provider over batches of rows."""
    provider = PROVIDERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider.run(batch)

    return rows.mapInPandas(run, provider.schema)
