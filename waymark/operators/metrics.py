"""Seconds and rows by stage, taken while the stages run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageMetrics:
    """`with metrics.timed("match"): ...` adds to a stage's seconds and count; `counted` observes
    the rows of a DataFrame while it is written, without a pass of its own."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.counts: dict[str, int] = {}
        self._seen: list[tuple[str, Observation]] = []

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[stage] = self.seconds.get(stage, 0.0) + time.monotonic() - began
            self.counts[stage] = self.counts.get(stage, 0) + 1

    def counted(self, df: DataFrame, stage: str) -> DataFrame:
        seen = Observation(f"stage-{len(self._seen)}-{stage}")
        self._seen.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """stage, seconds, count, rows; rows of observed DataFrames that have been run."""
        rows: dict[str, int] = {}
        for stage, seen in self._seen:
            rows[stage] = rows.get(stage, 0) + int(seen.get["rows"])
        names = sorted({*self.seconds, *rows})
        return spark.createDataFrame([(n, self.seconds.get(n, 0.0), self.counts.get(n, 0), rows.get(n)) for n in names], "stage string, seconds double, count long, rows long")
