"""Ratings: accepted records and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip


def accepted(records: DataFrame) -> DataFrame:
    """Valid ratings with their fields trimmed and cut to their limits."""
    ok = records.where(F.col("rating").isin("up", "down") & (strip(F.coalesce("question", F.lit(""))) != ""))
    limits = {"question": 500, "answer": 2000, "mode": 100, "comment": 1000}
    return ok.withColumns({c: F.substring(strip(F.coalesce(c, F.lit(""))), 1, n) for c, n in limits.items()})


def mode_name(mode: Column) -> Column:
    """Mode before its bracket, 'unknown' where there is none."""
    return F.coalesce(F.nullif(F.split(F.coalesce(mode, F.lit("")), r" \(", 2)[0], F.lit("")), F.lit("unknown"))


def summary(ratings: DataFrame) -> DataFrame:
    day = F.nullif(F.substring("at_utc", 1, 10), F.lit(""))
    up = F.sum((F.col("rating") == "up").cast("int"))
    return ratings.agg(
        F.count("*").alias("ratings"), up.alias("helpful"), F.sum((F.col("rating") == "down").cast("int")).alias("not_helpful"),
        F.count_distinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.round(100.0 * up / F.count("*"), 6).alias("helpful_pct"),
    )


def modes(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(mode_name(F.col("mode")).alias("mode_name")).agg(F.count("*").alias("n"))


def attempts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Attempts of a key in the last ``seconds`` up to and with each event. A key's time is cut into
    buckets of that length and every event also stands in the bucket after its own, so a frame never
    reaches beyond its bucket and a hot key spreads over as many tasks as it has buckets."""
    span = seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(F.col("_us") / span)
    twice = F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own"))))
    rows = events.withColumn("_us", us).withColumn("_in", twice)
    w = Window.partitionBy(key, "_in.b").orderBy("_us").rangeBetween(-(span - 1), 0)
    return rows.withColumn("attempts", F.count("*").over(w)).where("_in.own").drop("_us", "_in")
