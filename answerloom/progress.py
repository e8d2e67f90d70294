"""How far the steps of a job came: counts taken while they run, without another pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Progress:
    """Named counts of rows, filled by the first action on each watched table.

    Steps of the same name are told apart by number: ``step``, ``step 2`` and so on.
    """

    def __init__(self):
        self._watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, step: str, **measures: Column) -> DataFrame:
        """``df``, counting its rows, and aggregates by name, as they pass."""
        number = 1 + sum(name == step or name.startswith(f"{step} ") for name in self._watched)
        observation = Observation()
        self._watched[step if number == 1 else f"{step} {number}"] = observation
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in measures.items()])

    def counts(self) -> dict[str, dict[str, int | None]]:
        """What was counted, by step. Waits for steps that have begun; every watched table has to be used by then."""
        return {step: dict(observation.get) for step, observation in self._watched.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, measure, value), a row for each count."""
        rows = [(step, measure, value) for step, found in self.counts().items() for measure, value in found.items()]
        return spark.createDataFrame(rows, "step string, measure string, value bigint")


def watched(progress: Progress | None, df: DataFrame, step: str, **measures: Column) -> DataFrame:
    return df if progress is None else progress.watch(df, step, **measures)
