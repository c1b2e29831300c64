"""Streams: the row-wise stages (selection on nested events, features, scaling by a fitted table) hold no state, so they
apply to a streaming DataFrame as they are. There is no streaming-only operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarkflow.operators import features, scaling, select


def lead_jets(events: DataFrame, lo: float = select.PT_MIN, hi: float = select.PT_MAX) -> DataFrame:
    """Leading passing jet of each event (event, jets, electrons, muons) of a stream or a table."""
    best = select.leading(select.passing_jets(F.col("jets"), F.col("electrons"), F.col("muons"), lo=lo, hi=hi))
    return events.withColumn("j", best).where("j is not null").select("event", "j.*")


def scaled_particles(tables: DataFrame, scalers: dict[str, tuple[str, float | None, float | None]], names: tuple[str, ...]) -> DataFrame:
    """Rows with `parts`: features added, particles in bounds kept, the named arrays scaled by a fitted table."""
    df = tables.withColumn("parts", features.bounded(features.with_features(F.col("parts"))))
    arrays = scaling.apply_scalers({n: F.col(f"parts.{n}") for n in names}, scalers)
    return df.select(*(c for c in df.columns if c != "parts"), *(c.alias(n) for n, c in arrays.items()))
