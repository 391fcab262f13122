"""Prefix sums of weights, in two levels, and their differences by buckets of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SPAN = 4096
BUCKET = 256  # positions of a bucket, or as many as the longest occurrence has if that is more


def prefix_sums(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, pos, w) with `ps`, the sum of w up to and including pos.

    Positions are summed inside spans first, and the spans' totals over the document: a task holds a span, or one row
    for each span of a document, never all positions of a long text. Totals join by broadcast or shuffle, as they fit.
    """
    cut = rows.withColumn("_span", F.floor(F.col("pos") / span))
    inner = Window.partitionBy("doc_id", "_span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.sum("w").over(inner))
    totals = cut.groupBy("doc_id", "_span").agg(F.sum("w").alias("_t"))
    outer = Window.partitionBy("doc_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("doc_id", "_span", F.sum("_t").over(outer).alias("_before"))
    out = own.join(before, ["doc_id", "_span"])
    return out.select("doc_id", "pos", "w", F.when(F.col("_before").isNull(), F.col("_own")).otherwise(F.col("_own") + F.col("_before")).alias("ps"))


def occurrence_utility(sums: DataFrame, found: DataFrame) -> DataFrame:
    """Utility of occurrences (doc_id, pos, len) as the difference of two prefix sums, by equi-joins on (doc_id, pos).

    For many occurrences over given sums; single passes over texts are cheaper with grams().
    """
    high = sums.select("doc_id", F.col("pos").alias("_e"), F.col("ps").alias("_high"))
    low = sums.select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("ps").alias("_low"))
    out = found.withColumn("_e", F.col("pos") + F.col("len") - 1).join(high, ["doc_id", "_e"]).join(low, ["doc_id", "pos"], "left")
    return out.withColumn("utility", F.col("_high") - F.when(F.col("_low").isNull(), F.lit(0)).otherwise(F.col("_low"))).drop("_e", "_high", "_low")


def sum_buckets(sums: DataFrame, longest: int) -> DataFrame:
    """(doc_id, bucket, ps): prefix sums (doc_id, pos, ps) in rows of one array for each bucket of positions.

    A bucket has the sum before its first position, and reaches `longest` - 1 positions further than its own, so that it holds both
    ends of every occurrence of up to `longest` symbols that starts in it. Positions are without gaps, from 0.
    """
    size = max(BUCKET, longest)
    own = F.floor(F.col("pos") / size)
    first = F.floor(F.greatest(F.col("pos") - longest + 1, F.lit(0)) / size)
    each = sums.select("doc_id", "pos", "ps", F.explode(F.sequence(first, F.floor((F.col("pos") + 1) / size))).alias("bucket"))
    arrays = each.groupBy("doc_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "ps"))).alias("s"), F.max(own).alias("_own"))
    arrays = arrays.where(F.col("_own") >= F.col("bucket"))  # a bucket of nothing but the sum before it
    zero = F.array(F.lit(0).cast(sums.schema["ps"].dataType))
    return arrays.select("doc_id", "bucket", F.concat(F.when(F.col("bucket") == 0, zero).otherwise(F.slice(zero, 1, 0)), F.col("s.ps")).alias("ps"))


def bucket_utility(buckets: DataFrame, found: DataFrame, longest: int) -> DataFrame:
    """`found` (doc_id, pos, len, ...) with `utility`, from sum_buckets() made for the same `longest`, by one equi-join on (doc_id, bucket).

    Arrays travel once for each bucket, never with an occurrence. Occurrences that end beyond a text get null.
    """
    size = max(BUCKET, longest)
    at = (F.col("pos") % size).cast("int")
    out = found.withColumn("bucket", F.floor(F.col("pos") / size)).join(buckets.withColumnRenamed("ps", "_ps"), ["doc_id", "bucket"])
    own = F.get("_ps", at + F.col("len").cast("int")) - F.get("_ps", at)
    return out.select(*found.columns, own.alias("utility"))
