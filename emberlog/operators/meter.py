"""Counts gathered while a run's own writes pass, without another scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


class Meter:
    """Named metrics of the stages of one run.

    ``watch`` is for tables that are written right after it, behind the last shuffle: Spark counts each
    partition of a final stage once, also if tasks are run again after an executor is lost.
    """

    def __init__(self) -> None:
        self._observed: list[Observation] = []
        self._known: dict[str, object] = {}

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` unchanged; its ``metrics`` are known once it has been written."""
        seen = Observation()
        self._observed.append(seen)
        return df.observe(seen, *[column.alias(name) for name, column in metrics.items()])

    def note(self, **facts) -> None:
        """Facts known from elsewhere."""
        self._known |= facts

    def read(self) -> dict:
        """All metrics; call it after the watched tables are written, else it waits for them."""
        known = dict(self._known)
        for seen in self._observed:
            known |= seen.get
        return known
