"""Which source serves which part of a period."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..model import SourceKind, TimeRange


@dataclass(frozen=True)
class Instruction:
    kind: SourceKind
    period: TimeRange


def archive_until(now: datetime, lag_days: int = 2) -> datetime:
    """Files up to here are published: midnight, ``lag_days`` ago."""
    return (now - timedelta(days=lag_days)).replace(hour=0, minute=0, second=0, microsecond=0)


def route(period: TimeRange, now: datetime, *, lag_days: int = 2, least_archive: timedelta = timedelta(days=2)) -> list[Instruction]:
    """Archive up to the cutoff and paged requests after it; all requests if the period is too new or too short."""
    if period.is_empty:
        return []
    cutoff = archive_until(now, lag_days)
    if period.start >= cutoff or period.end - period.start < least_archive:
        return [Instruction(SourceKind.REST, period)]
    out = [Instruction(SourceKind.ARCHIVE, period.clamp_end(cutoff))]
    if period.end > cutoff:
        out.append(Instruction(SourceKind.REST, TimeRange(cutoff, period.end)))
    return out


def route_table(periods: DataFrame, now: datetime, start: str = "start", end: str = "end", *, lag_days: int = 2, least_archive: timedelta = timedelta(days=2)) -> DataFrame:
    """``route`` for every row of ``periods`` (half-open, timestamps): its columns, cut to the part that ``source`` serves."""
    cutoff, a, b = F.lit(archive_until(now, lag_days)), F.col(start), F.col(end)
    long_enough = F.unix_micros(b) - F.unix_micros(a) >= int(least_archive.total_seconds() * 1_000_000)
    part = lambda kind, x, y: F.struct(F.lit(kind.value).alias("source"), x.alias("a"), y.alias("b"))
    both = F.array(part(SourceKind.ARCHIVE, a, F.least(b, cutoff)), part(SourceKind.REST, F.greatest(a, cutoff), b))
    parts = F.when((a < cutoff) & long_enough, both).otherwise(F.array(part(SourceKind.REST, a, b)))
    others = [c for c in periods.columns if c not in (start, end)]
    return periods.where(a < b).select(*others, F.explode(parts).alias("p")).where("p.a < p.b").select(*others, "p.source", F.col("p.a").alias(start), F.col("p.b").alias(end))
