"""Operator 5, mixing sources to target weights along a curriculum. DataFrame functions only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share the corpus's words; a source's target
stops at three times its size and the excess goes to the others by weight (water filling, solved in closed form
over one row per source; windows over all sources are of few rows). Within a source documents stand in a fixed
pseudo-random order (MD5 of id and text, and of a number that tells repeated rows apart); the mix goes through that order again and again until the target is met to the word, so a document is taken whole some
times and the last one reached may be taken in part.

Curriculum: source s has the weight schedule ``share_s * (1 + a_s * (2t - 1))`` over training time t in 0..1, where
heavy sources fall and light ones rise and the shares add up to one at every t. Its integral is the source's
cumulative demand; inverting it at a document's place in the source gives the document's training position.

Plan: the text is read once for its word count; running sums are kept in two levels, (source, bucket of the order)
and inside one bucket, so a source with most rows spreads over its 4096 buckets, and so do the copies of one row.
The result is range-sorted by training position.

Defined results: null text has size 0; null source is a source of its own; null doc_id is kept; repeated rows are
documents of their own; a document of size 0 is never taken and has no position; an empty table gives no rows;
further columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, partitions_for, saved, table

WEIGHTS, MOST, TILT = (5, 2, 1), 3, 0.5


def _key(source: Column) -> Column:
    """A null-free stand-in for a source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """From (key, source, source_size), one row per source: its weight, target, whole words to take, and slope."""
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(w) for w in weights])
    heavy, light = max(weights), min(weights)
    # Slope class: the heaviest sources fall (-1), the lightest rise (+1), linear between.
    slope = F.lit(1.0) - F.lit(2.0) * (F.col("weight") - light) / F.lit(float(max(1, heavy - light)))
    filled = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    after = filled.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.partitionBy(F.lit(1))
    return (
        sizes.withColumn("weight", F.element_at(kinds, (F.row_number().over(ranked) - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(after))
        .withColumn("full", F.col("cap").cast("double") * F.col("others") <= F.col("left").cast("double") * F.col("weight"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_rows), F.lit(0)))
        .withColumn("others", F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_rows))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("left") * F.col("weight")).cast("double") / F.col("others")))
        .withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("class", slope)
        .withColumn("mean_class", F.sum(F.col("want") * F.col("class")).over(all_rows) / F.greatest(F.sum("want").over(all_rows), F.lit(1)))
        .withColumn("slope", F.lit(tilt) * (F.col("class") - F.col("mean_class")))
        .select("key", "source_size", "weight", "target", "want", "slope")
    )


def time_of(part: Column, slope: Column) -> Column:
    """Training time at which a source has used up ``part`` (0..1) of its demand: the inverse of t + a(t^2 - t)."""
    b = F.lit(1.0) - slope
    return F.when(part > 0, F.lit(2.0) * part / (b + F.sqrt(b * b + F.lit(4.0) * slope * part))).otherwise(F.lit(0.0))


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``__t`` (source_size, target, want, slope, before, taken) to rows of (..., __key, __order, __bucket, __size)."""
    own = W.partitionBy("__key", "__bucket").orderBy("__order", "__row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = rows.join(plan, (F.col("__key") == F.col("__plan_key")) & (F.col("__bucket") == F.col("__plan_bucket")))
    before = F.col("__base") + F.sum("__size").over(own) - F.col("__size")
    full = F.when(F.col("__source_size") > 0, F.floor(F.col("__want") / F.col("__source_size"))).otherwise(0).cast("long")
    rest = F.col("__want") - F.col("__full") * F.col("__source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__before")))
    return joined.withColumn("__before", before).withColumn("__full", full).withColumn("__extra", extra).withColumn("__taken", F.col("__full") * F.col("__size") + F.col("__extra"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """A row per document, saved: its source, word count, unique number, and place in the order."""
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    rows = saved(docs.select(*more, F.monotonically_increasing_id().alias("__row_id"), F.col("doc_id").alias("__id"), source.alias("__source"), _key(source).alias("__key"), name.alias("__name"), size.alias("__size")), "mix-sizes")
    again = saved(_repeats(rows), "mix-repeats")
    numbered = rows.join(again, "__row_id", "left").withColumn("__order", F.md5(F.concat("__name", F.lit(":"), F.coalesce("__again", F.lit(0)).cast("string"))))
    return numbered.withColumn("__bucket", F.substring("__order", 1, 3)).drop("__name", "__again")


def _repeats(rows: DataFrame) -> DataFrame:
    """(__row_id, __again): numbers from 0 for rows that repeat another of their source; counted by piece of the table, so that no
    task holds all copies of a row."""
    keys = ["__key", "__name"]
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    copies = rows.select("__row_id", *keys, F.floor(F.col("__row_id") / 65_536).alias("part")).join(repeated, keys, "left_semi")
    parts = copies.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    bases = parts.select(*keys, "part", (F.sum("n").over(W.partitionBy(*keys).orderBy("part")) - F.col("n")).alias("base"))
    inside = W.partitionBy(*keys, "part").orderBy("__row_id")
    own = copies.withColumn("at", F.row_number().over(inside) - 1)
    return own.join(bases, [*keys, "part"]).select("__row_id", (F.col("base") + F.col("at")).alias("__again"))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int, tilt: float) -> DataFrame:
    """One row per (source, bucket): words of the source before the bucket, and the source's targets."""
    buckets = saved(sized.groupBy("__key", "__bucket").agg(F.max("__source").alias("source"), F.sum("__size").alias("words")), "mix-buckets")
    sizes = buckets.groupBy(F.col("__key").alias("key")).agg(F.max("source").alias("source"), F.sum("words").alias("source_size"))
    base = F.sum("words").over(W.partitionBy("__key").orderBy("__bucket")) - F.col("words")
    aims = targets(sizes, weights, most, tilt)
    return buckets.select(F.col("__key").alias("__plan_key"), F.col("__bucket").alias("__plan_bucket"), base.alias("__base")).join(
        aims.select("key", *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "want", "slope")]), F.col("key") == F.col("__plan_key")
    ).drop("key")


def _position(turn: Column) -> Column:
    done = turn * F.col("__source_size") + F.col("__before")
    return time_of(done.cast("double") / F.col("__want"), F.col("__slope"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position), range-sorted by position, the first training position (0 to 1);
    documents that the mix doesn't take come first and have none."""
    sized = _sized(docs)
    rows = placed(sized, saved(_plan(sized, weights, most, tilt), "mix-plan"))
    first = F.when(F.col("__taken") > 0, _position(F.lit(0)))
    rows = rows.withColumn("__at", first).repartitionByRange(partitions_for(docs.sparkSession), "__at", "__order").sortWithinPartitions("__at", "__order")
    return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), F.col("__at").alias("position"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every time a document is taken, range-sorted by training
    position; where a document is taken in part, its text is cut after the last word taken."""
    sized = _sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    rows = placed(sized, saved(_plan(sized, weights, most, tilt), "mix-plan"))
    turns = F.sequence(F.lit(0).cast("long"), F.col("__full") - F.when(F.col("__extra") > 0, 0).otherwise(1))
    taken = rows.where(F.col("__taken") > 0).withColumn("__turn", F.explode(turns)).withColumn("__at", _position(F.col("__turn")))
    worded = F.regexp_extract_all(F.col("__row.text").cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(worded, F.lit(1), F.col("__extra").cast("int")), "")
    cut = F.when((F.col("__turn") == F.col("__full")) & (F.col("__extra") < F.col("__size")), head).otherwise(F.col("__row.text"))
    sorted_rows = taken.withColumn("__text", cut).repartitionByRange(partitions_for(docs.sparkSession), "__at", "__order", "__turn").sortWithinPartitions("__at", "__order", "__turn")
    return sorted_rows.select(*[F.col("__text").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1)) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, (source_size * 3)::BIGINT AS cap, (sum(source_size) OVER ())::BIGINT AS total,
         (coalesce(sum(source_size * 3) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS used,
         (sum(weight) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS others
  FROM s),
g AS (SELECT *, cap::DOUBLE * others <= (total - used)::DOUBLE * weight AS is_full FROM f),
h AS (
  SELECT source, source_size, weight, CASE WHEN is_full THEN cap::DOUBLE ELSE
         ((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))::BIGINT * weight)::DOUBLE
         / (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::BIGINT END AS target
  FROM g),
w AS (
  SELECT *, floor(target + 0.5)::BIGINT AS want, 1.0::DOUBLE - 2.0::DOUBLE * (weight - 1) / 4.0::DOUBLE AS class FROM h),
a AS (
  SELECT *, 0.5::DOUBLE * (class - sum(want * class) OVER () / greatest((sum(want) OVER ())::BIGINT, 1)) AS slope FROM w),
p AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, a.want, a.slope,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before,
         CASE WHEN a.source_size > 0 THEN a.want // a.source_size ELSE 0 END AS full_turns
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
t AS (
  SELECT *, (full_turns * size + greatest(0, least(size, want - full_turns * source_size - before)))::BIGINT AS taken,
         before::DOUBLE / want AS part, 1.0::DOUBLE - slope AS b FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN part > 0 THEN 2.0::DOUBLE * part / (b + sqrt(b * b + 4.0::DOUBLE * slope * part)) ELSE 0.0::DOUBLE END END AS position
FROM t
"""
