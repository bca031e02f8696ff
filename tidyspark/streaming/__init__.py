"""Structured Streaming: the stateless verbs work on streams as they are; these add sources, windows and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.expr import wrap
from ..plans.tbl import Ctx, Tbl, as_tbl, verb


def read_stream(path: str, schema, spark: SparkSession, format: str = "parquet", **options) -> Tbl:
    return Tbl(spark.readStream.format(format).schema(schema).options(**options).load(path))


@verb
def with_watermark(tbl: Tbl, column: str, delay: str) -> Tbl:
    return tbl.with_df(tbl.df.withWatermark(column, delay))


@verb
def window_by(tbl: Tbl, time, duration: str, slide: str | None = None, name: str = "window") -> Tbl:
    """Tumbling or sliding windows as a further group."""
    w = F.window(Ctx(tbl, "row").bind(wrap(time)), duration, slide) if slide else F.window(Ctx(tbl, "row").bind(wrap(time)), duration)
    return Tbl(tbl.df.withColumn(name, w), (*tbl.groups, name), "grouped", (), tbl.drop)


@verb
def session_by(tbl: Tbl, time, gap: str, name: str = "session") -> Tbl:
    return Tbl(tbl.df.withColumn(name, F.session_window(Ctx(tbl, "row").bind(wrap(time)), gap)), (*tbl.groups, name), "grouped", (), tbl.drop)


def start(tbl, checkpoint: str, path: str | None = None, format: str = "parquet", mode: str = "append", **options):
    """Start a query; the checkpoint folder makes it recoverable."""
    df: DataFrame = as_tbl(tbl).df
    writer = df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    return writer.start(path) if path else writer.start()
