"""What a conversion repaired, in one aggregation over the carrier's counter columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = {"n_quote": "quotes", "n_fallback": "fallback", "n_trail": "trailing", "n_join": "joined", "n_realign": "realigned", "n_bad": "malformed", "n_moji": "unmojibaked"}
#: Trailing delimiters are no damage.
FREE = {"trailing"}


@dataclass
class Metrics:
    rows: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    mismatches: int = 0

    @property
    def problems(self) -> int:
        return self.mismatches + sum(n for k, n in self.counts.items() if k not in FREE)

    @property
    def exit_code(self) -> int:
        return 2 if self.problems else 0


def counters(guarded: DataFrame) -> list[Column]:
    """Aggregates of a guarded carrier; dropped rows count as malformed, not as rows."""
    there = [c for c in COUNTERS if c in guarded.columns]
    return [F.count_if(~F.col("dropped")).alias("rows"), *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in there)]


def of_counters(found: dict) -> Metrics:
    return Metrics(found["rows"], {COUNTERS[c]: n for c, n in found.items() if c in COUNTERS})


def measured(guarded: DataFrame) -> Metrics:
    return of_counters(guarded.agg(*counters(guarded)).first().asDict())
