"""What the operators share: the shared folder, free column names, bounded labelled samples, joins on keys of which some are hot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: ASCII white space; words are the runs of everything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder the session was given."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        # executors on other machines could not read a folder of the driver's
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of text that a classifier's sample may hold on the driver.
SAMPLE_BYTES = 64 << 20


def within_bytes(rows: DataFrame, text: str, keys: list[str], limit: int = SAMPLE_BYTES) -> DataFrame:
    """The rows, in the order of a hash of ``keys``, until their texts reach ``limit`` bytes; whole texts only.

    ``rows`` is a sample already bounded in rows: they are summed up in one task.
    """
    from pyspark.sql import Window

    total = free_name(rows, "bytes")
    w = Window.orderBy(F.xxhash64(*(col(k) for k in keys)), *(col(k) for k in keys)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(total, F.sum(F.octet_length(F.coalesce(col(text), F.lit("")))).over(w)).filter(col(total) <= limit).drop(total)


def labelled_texts(docs: DataFrame, chosen: DataFrame, limit: int = SAMPLE_BYTES) -> list:
    """Rows of ``chosen`` (k, labels; bounded in rows) with the text of their document; ``docs`` has k and text.

    A repeated id gives one text (the one whose hash is least), so the rows stay as many as ``chosen`` has.
    """
    texts = docs.join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi").groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return within_bytes(texts.join(F.broadcast(chosen), "k"), "text", [c for c in chosen.columns if c == "k"] + [c for c in chosen.columns if c != "k"], limit).collect()


#: Bytes of a batch of rows on its way to a Python worker; a longer row goes alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cuts Arrow batches by bytes as well, for the rest of the session: Spark's 10,000 rows, or 64 MB, of whole texts are
    held several times over, in the executor and in its workers.  A limit that the session was given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Shelf:
    """Tables written as Parquet to the shared folder, which cuts lineage; unlike a checkpoint, a table read back brings
    its true size to the planner and none of the constraints of the plan that made it, which pile up in loops.  The shuffle
    files of a table's plan are deleted when it is written; else they stay until the driver collects its garbage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.parquet(f"{self.root}/{self.n}")
        finally:
            self.spark.conf.set(key, before) if before is not None else self.spark.conf.unset(key)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def clear(self) -> None:
        """Deletes the tables; nothing read from them may be used any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant that no column has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def id_remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: Column) -> Column:
    """Array of a text's words; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def bounded_sample(df: DataFrame, label: str, per_class: int, keys: list[str]) -> DataFrame:
    """About ``per_class`` rows of each label (all, where there are fewer), chosen by a hash of ``keys``.

    The share to keep follows from the label's count over all rows, so rows go
    before any shuffle; never more than 1.25 * per_class + 100 rows of a label remain.
    """
    counts = {r[0]: r[1] for r in df.groupBy(col(label)).count().collect() if r[0] is not None}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    h, k = free_name(df, "sample_h"), free_name(df, "sample_k")
    spread = F.pmod(F.xxhash64(*(col(c) for c in keys)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    from pyspark.sql import Window

    w = Window.partitionBy(col(label)).orderBy(col(h), *(col(c) for c in keys))
    return df.withColumn(h, spread).filter(col(h) < share).withColumn(k, F.row_number().over(w)).filter(col(k) <= int(1.25 * per_class + 100)).drop(h, k)


#: A table of at most so many narrow rows is broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 200_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, weight: str, heavy_rows: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``keys``, where few keys may hold much of ``left``.

    ``right`` has one row a key and the key's number of rows in ``left`` in column
    ``weight``.  Up to ``broadcast_rows`` rows, all of ``right`` is broadcast.  Beyond, a key with more than
    1/heavy_rows of all rows is heavy; by the pigeonhole principle there are fewer than ``heavy_rows`` such keys at any
    size of the input, so they are broadcast, and heavy rows of ``left`` go to partitions by ``spread`` instead of their
    key.  Key columns must not be null.  ``weight`` isn't returned.
    """
    total, n = right.agg(F.sum(weight), F.count(F.lit(1))).first()
    if n <= broadcast_rows:
        return left.join(F.broadcast(right.drop(weight)), keys, "left")
    values = [c for c in right.columns if c not in keys and c != weight]
    limit = max(1, (total or 0) // heavy_rows)
    heavy = right.filter(col(weight) > limit)
    hot = F.broadcast(heavy.select(*keys, F.struct(*(col(v) for v in values)).alias("_hot")))
    rest = right.filter(col(weight) <= limit).select(*keys, F.struct(*(col(v) for v in values)).alias("_cold"), F.lit(-1).alias("_salt"))
    marked = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.hash(spread), F.lit(1 << 20))))
    joined = marked.join(rest, [*keys, "_salt"], "left")
    kept = [col(c) for c in left.columns]
    return joined.select(*kept, *(F.coalesce(F.col("_hot").getField(v), F.col("_cold").getField(v)).alias(v) for v in values))
