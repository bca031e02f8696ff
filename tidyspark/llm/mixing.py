"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

1. Each source gets a target: its share of the budget by weight, stopped at ``max_repeats`` times its size, the excess
   reshared by weight (water-filling, solved in one ordered pass over the sources).
2. Each source's documents stand in a fixed pseudo-random order (md5 of the id) and are read round after round until the
   target is used up; the document at the target is taken in part.
3. A source's weight schedule is piecewise linear in training time [0, 1].  Its integral, scaled to the target, is the
   source's cumulative token demand; inverting it at a document's cumulative offset gives the document's training
   position, and documents are range-sorted by position.

Offsets are prefix sums in two levels over range partitions of the narrow rows (source, order key, ids): sums per
(source, part), then inside a part.  The number of parts grows with the rows, and the row's number is the last sort key, so
neither a large source nor an id or a row that is repeated without end makes a large group.  Documents that the mix takes
move whole twice, once to meet their visits and once to their place; the others stay.

Defined cases: a null text has size 0 and is never taken; null is a source of its own, the last by rank; repeated rows
are documents of their own; a source of size 0 has target 0; an empty table gives an empty plan; other columns are
ignored by the plan and kept by ``mix_documents``.  Sources are a dimension: one row each is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Shelf, col, free_name, read

WEIGHTS = (5, 2, 1)
BUDGET, MAX_REPEATS = 1.5, 2
#: Rows that a range partition of the plan holds at most, on average.
PART_ROWS = 500_000
#: Weight schedules as (time, relative weight) knots, repeating over the ranks like WEIGHTS: the first fades, the second
#: is even, the third grows.  Only the shape counts; each is scaled to integrate to the source's target.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def _invert(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time at which a schedule's integral reaches ``share`` of its total."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w <= 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with positive weights")
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, area = F.lit(0.0), 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        w0, w1 = w0 / total, w1 / total
        u, slope = share - F.lit(area), (w1 - w0) / (t1 - t0)
        # root of w0 * x + slope * x**2 / 2 = u, in the form that has no cancellation
        x = 2 * u / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * u)))
        out = F.when(share >= F.lit(area), F.least(F.lit(1.0), F.lit(t0) + x)).otherwise(out)
        area += (t1 - t0) * (w0 + w1) / 2
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size): adds rank (from 0, code point order, null last), weight and target."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(max_repeats)
    ordered = everything.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    # level: demand per weight if the sources before this one stop at their caps and no other does
    ranked = ranked.withColumn("cap", cap).withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("cap").over(ordered), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ordered), F.lit(0))),
    )
    free = F.col("cap") > F.col("level") * F.col("weight")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everything)
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target"))


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, shelf: Shelf | None = None) -> DataFrame:
    """From (source, size, order_key, ...): adds source_size, target, taken and ``visits``.

    ``order_key`` is a lower-case hex string that orders a source's documents.  ``visits`` has one
    (round, words, position) for each time the mix takes the document.
    """
    spark, names = rows.sparkSession, list(rows.columns)
    shelf = shelf or Shelf(spark, "mix-plan")
    keyed = shelf.put(rows.withColumn("_s", _source_key("source")))
    order = ["order_key", *(c for c in ("doc_id", "size", "text_hash", "row") if c in names)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keyed.count() // PART_ROWS + 1)
    keyed = shelf.put(keyed.repartitionByRange(parts, "_s", *order).withColumn("_p", F.spark_partition_id()))
    sums = keyed.groupBy("_s", "_p").agg(F.sum("size").alias("n"), F.first("source").alias("source"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = shelf.put(sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    sizes = sums.groupBy("_s").agg(F.sum("n").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes.drop("_s"), weights, budget, max_repeats).withColumn("_s", _source_key("source")).drop("source")
    bases = sums.select("_s", "_p", "base").join(targets, "_s")
    inside = Window.partitionBy("_s", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["_s", "_p"])
    start = F.col("base") + F.col("_in")
    whole = F.floor(F.col("target") + F.lit(0.5))

    def visit(p: int) -> Column:
        at = F.lit(p) * F.col("source_size") + start
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - at)).cast("long")
        share = F.when(F.col("target") > 0, F.least(F.lit(1.0), at / F.col("target"))).otherwise(F.lit(0.0))
        position = F.lit(0.0)
        for i, knots in enumerate(schedules):
            position = F.when(F.col("rank") % len(schedules) == i, _invert(knots, share)).otherwise(position)
        return F.struct(F.lit(p).alias("round"), words.alias("words"), position.alias("position"))

    visits = F.filter(F.array(*map(visit, range(max_repeats))), lambda v: v["words"] > 0)
    out = placed.withColumn("visits", visits)
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda a, v: a + v["words"])
    return out.select(*names, "source_size", "target", taken.alias("taken"), "visits")


def _source_key(source: Column | str) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _order_key(doc_id: str) -> Column:
    return F.md5(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary"))


def _rows(docs: DataFrame, text: str, doc_id: str, source: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), size.alias("size"), _order_key(doc_id).alias("order_key"), F.xxhash64(col(text)).alias("text_hash"), *more)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", row: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(plan, mixed).  ``plan``: a row for each document, see ``mix_plan``, with its ``row``.  ``mixed``: (row, position, doc)
    for each visit, range-sorted by training position; ``doc`` is a struct of the columns of ``docs`` with the text as taken.

    A document taken in part keeps its first words and the white space between them.  ``row`` names a column that tells all
    rows apart and is the same at each reading; without one, the documents are written with a number first.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    kept, names, key = docs, list(docs.columns), row
    if key is None:
        key = free_name(docs, "mix_row")
        kept = shelf.put(docs.withColumn(key, F.monotonically_increasing_id()))
    plan = shelf.put(mix_plan(_rows(kept, text, doc_id, source, col(key).alias("row")), shelf=shelf, **options))
    visits = shelf.put(plan.select("row", "size", F.xxhash64("order_key").alias("tie"), F.explode("visits").alias("v")).select("row", "size", "tie", "v.words", "v.position"))
    # the narrow visits are range-sorted first, so whole documents go straight to their partition
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, visits.count() // PART_ROWS + 1)
    visits = visits.repartitionByRange(parts, "position", "tie", "row").withColumn("part", F.spark_partition_id())
    each = visits.groupBy("row").agg(F.first("size").alias("size"), F.collect_list(F.struct("position", "tie", "words", "part")).alias("visits"))  # at most max_repeats
    # documents behind the last that a source's target reaches stay where they are
    last = plan.filter(F.size("visits") > 0).groupBy(_source_key("source").alias("_s")).agg(F.max("order_key").alias("last"))
    whole = kept.select(F.struct(*(col(c) for c in names)).alias("doc"), col(key).alias("row"), _source_key(col(source)).alias("_s"), _order_key(doc_id).alias("order_key"))
    whole = whole.join(F.broadcast(last), "_s").filter("order_key <= last").select("doc", "row")
    v = whole.join(each, "row").select("doc", "size", "row", F.explode("visits").alias("v"))
    body = F.when(F.col("v.words") == F.col("size"), F.col("doc").getField(text)).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(F.col("doc").getField(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("v.words").cast("int")), "")
    )
    v = v.repartitionById(parts, F.col("v.part")).sortWithinPartitions("v.position", "v.tie", "row")
    doc = F.struct(*((body if c == text else F.col("doc").getField(c)).alias(c) for c in names))
    return plan, v.select("row", F.col("v.position").alias("position"), doc.alias("doc"))


def mix_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: a row for each visit, all columns of ``docs``, range-sorted by training position."""
    mixed = mix(docs, text, doc_id, source, **options)[1]
    return mixed.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken and first position as counted in the mixed, range-sorted texts themselves."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    # a file's number and a row's place in its file are the same at each reading; one row a file is sorted in one task
    files = docs.select("path").distinct().select("path", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")).alias("file"))
    files = Shelf(spark, "mix-files").put(files)
    docs = docs.join(F.broadcast(files), "path").select("doc_id", "text", "source", (F.shiftleft(F.col("file").cast("long"), 40) + F.col("at")).alias("row"))
    plan, mixed = mix(docs, row="row")
    # numbered behind the sort, which so can't be left out of the plan
    mixed = mixed.select("row", "position", F.regexp_count("doc.text", F.lit(WORD)).alias("words"), F.monotonically_increasing_id().alias("place"))
    got = mixed.groupBy("row").agg(F.sum("words").cast("long").alias("taken"), F.min_by("position", "place").alias("first"))
    out = plan.drop("taken", "visits").join(got, "row", "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.round("first", 6).alias("first_position"))


def plan_sql(table: str, prefix: str = "") -> str:
    """CTEs ending in ``mixed`` (one row per document: rid, size, source_size, target, taken, start, whole)."""
    return rf"""
s0 as (select row_number() over () as rid, *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as order_key from {table}),
s1 as (select source, sum(size)::bigint as source_size from s0 group by source),
s2 as (select *, row_number() over (order by source is null, source) - 1 as rank from s1),
s3 as (select *, [5, 2, 1][rank % 3 + 1] as weight, 2 * source_size as cap from s2),
s4 as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
       from s3 window o as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
s5 as (select min_by(level, (cap / weight, rank)) as level from s4 where cap > level * weight),
s6 as (select s4.source, source_size, rank, case when s5.level is null then cap::double else least(cap::double, s5.level * weight) end as target from s4 cross join s5),
mixed as (select s0.*, source_size, target, rank, floor(target + 0.5) as whole,
       coalesce(sum(s0.size) over (partition by s0.source order by order_key, doc_id, s0.size rows between unbounded preceding and 1 preceding), 0) as start
       from s0 join s6 on s0.source is not distinct from s6.source)"""


ORACLE = f"""with {plan_sql("documents")},
v as (select *, start / target as share from mixed),
taken as (select *, greatest(0, least(size, whole - start)) as first_words, greatest(0, least(size, whole - start - source_size)) as second_words from v),
seg as (select *, case when rank % 3 = 0 then 0.0 when rank % 3 = 1 then 0.0 when share >= 0.3125 / 0.9375 then 0.3125 / 0.9375 else 0.0 end as a0,
  case when rank % 3 = 2 and share >= 0.3125 / 0.9375 then 0.5 else 0.0 end as t0,
  case when rank % 3 = 0 then 1.5 when rank % 3 = 1 then 1.0 when share >= 0.3125 / 0.9375 then 0.75 / 0.9375 else 0.5 / 0.9375 end as w0,
  case when rank % 3 = 0 then -1.0 when rank % 3 = 1 then 0.0 when share >= 0.3125 / 0.9375 then 2.0 / 0.9375 else 0.5 / 0.9375 end as k from taken)
select doc_id, size, source, source_size, target, (first_words + second_words)::bigint as taken,
  round(case when first_words > 0 then least(1.0, t0 + 2 * (share - a0) / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * k * (share - a0))))) end, 6) as first_position from seg"""
