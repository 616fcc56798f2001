"""Extensions: streaming forms of progress files and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, by seq; one aggregation, so it also serves a stream in complete or update mode."""
    rest = [c for c in df.columns if c not in (key, seq)]
    return df.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("r_")).select(key, seq, "r_.*")


def telemetry(df: DataFrame, ts: str, group: str, value: str, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Mean, maximum and count of value in tumbling windows; rows later than `late` are dropped in a stream."""
    x = df.withWatermark(ts, late) if df.isStreaming else df
    g = x.groupBy(F.window(ts, width).alias("w"), group).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), group, "mean", "most", "n")


def unseen(df: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key has not come before, within the watermark in a stream."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])
