"""Checkpoints of incremental scans: where a scan starts, and how far it has come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scan looks back at most so long, reaches further than the time since the last one by a margin, and never less than the least, in ms.
LONGEST, MARGIN, LEAST = 90 * 24 * 3600 * 1000, 5 * 60 * 1000, 60 * 1000


def scan_window(latest_ms: Column, now_ms: Column) -> Column:
    """How far back a scan looks when it starts, from the time of the latest checkpoint; without one, as far as it may."""
    window = F.least(F.greatest(now_ms - latest_ms + MARGIN, F.lit(LEAST)), F.lit(LONGEST))
    return F.when(F.coalesce(latest_ms, F.lit(0)) > 0, window).otherwise(LONGEST)


def latest(state: DataFrame, prefix: str | None = None) -> DataFrame:
    """(agent, updated_at_ms): the time of each agent's latest checkpoint, of sources that are the prefix or lie below it."""
    if prefix is not None:
        state = state.filter((F.col("source_key") == prefix) | F.col("source_key").startswith(prefix + "/"))
    return state.groupBy("agent").agg(F.max("updated_at_ms").alias("updated_at_ms"))


def advanced(state: DataFrame, read: DataFrame, cutoff_ms: int) -> DataFrame:
    """state with the offsets that a scan has read to; a source whose entries all fell before the cutoff stays, to be read again with an earlier one.

    state: (source_key, file_size, file_mtime_ms, file_offset); read: these and n_entries, n_late (entries before the cutoff).
    """
    keep = (F.col("n_entries") > 0) & (F.col("n_late") == F.col("n_entries"))
    done = read.filter(~keep).select(state.columns)
    return state.join(done.select("source_key"), "source_key", "left_anti").select(state.columns).unionByName(done)


def to_read(state: DataFrame, files: DataFrame) -> DataFrame:
    """(source_key, start): sources that changed since their checkpoint, with the offset to go on from: 0 if they are new, shrank, or changed at the same size."""
    joined = files.alias("f").join(state.alias("s"), "source_key", "left")
    same = (F.col("f.file_size") == F.col("s.file_size")) & (F.col("f.file_mtime_ms") == F.col("s.file_mtime_ms"))
    anew = F.col("s.file_offset").isNull() | (F.col("f.file_size") <= F.col("s.file_size"))
    return joined.filter(~F.coalesce(same, F.lit(False))).select("source_key", F.when(anew, F.lit(0)).otherwise(F.col("s.file_offset")).cast("long").alias("start"))
