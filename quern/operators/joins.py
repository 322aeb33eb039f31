"""Join forms that Spark has no equi-join plan for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most cells that `cover_counts` cuts time into; their totals are put in order in one task and broadcast.
MOST_CELLS = 100_000


def interval_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width_seconds: int) -> DataFrame:
    """Pairs of a point and a span with low <= at < high.

    A plain range predicate is a nested loop over both sides. Here time is cut
    into cells of `width_seconds`, and into cells twice, four times, eight times .. as wide; a span is
    entered in the cells of the least width that its length doesn't exceed, two at most, and a point
    in its cell of every width that spans have (at most 64). Cells are joined by equality, and each pair meets
    in exactly one cell. Choose the width near the usual length of a span.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    base = width_seconds * 1_000_000
    wide = lambda: F.lit(base).cast("long") * F.expr("shiftleft(1L, quern_level)")
    length = F.greatest((micros(high) - micros(low)) / base, F.lit(1.0))
    sized = spans.where(F.col(low) < F.col(high)).withColumn("quern_level", F.ceil(F.log2(length)).cast("int"))
    levels = sorted(r[0] for r in sized.select("quern_level").distinct().collect())  # a number for each width
    cell = lambda c: F.floor(micros(c) / wide()).cast("long")
    placed = sized.withColumn("quern_cell", F.explode(F.sequence(cell(low), cell(high))))
    spread = points.withColumn("quern_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("quern_cell", cell(at))
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    return spread.join(placed, ["quern_level", "quern_cell"]).where(inside).drop("quern_level", "quern_cell")


def _micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a date or a timestamp; those without a time zone are taken as they stand."""
    if rows.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(name)
    since = F.col(name).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def cover_counts(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width_seconds: int) -> DataFrame:
    """Rows of points, and as n the number of spans with low <= at < high; only where there are any.

    No pairs are made, so work grows with the rows of both sides however many spans cover a point: every span adds
    1 at low and -1 at high, and a point takes the running sum. Time is cut into cells of `width_seconds`, wider ones
    if the spans would have more than `MOST_CELLS`; a task sums a cell at a time, from what is open at its start.
    """
    real = spans.select(_micros(spans, low).alias("low"), _micros(spans, high).alias("high")).where("low < high")
    first, last = real.agg(F.min("low"), F.max("high")).first()
    if first is None:
        return points.where(F.lit(False)).withColumn("n", F.lit(0).cast("long"))
    width = max(width_seconds * 1_000_000, (last - first) // MOST_CELLS + 1)
    cell = F.expr(f"(t - ({first}L)) div {width}L AS cell")  # whole numbers: a double can't hold all microseconds
    marks = real.select(F.inline(F.array(*(F.struct(F.col(c).alias("t"), F.lit(d).cast("long").alias("d")) for c, d in (("low", 1), ("high", -1)))))).select(cell, "t", "d")
    placed = points.select(_micros(points, at).alias("t"), F.struct(*points.columns).alias("point")).where((F.col("t") >= first) & (F.col("t") < last))
    both = marks.withColumn("point", F.lit(None)).unionByName(placed.select(cell, "t", F.lit(0).cast("long").alias("d"), "point"))
    summed = both.withColumn("inside", F.sum("d").over(Window.partitionBy("cell").orderBy("t", F.col("point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)))
    cells = points.sparkSession.range((last - first) // width + 1).select(F.col("id").alias("cell")).join(marks.groupBy("cell").agg(F.sum("d").alias("d")), "cell", "left")
    opened = cells.select("cell", F.coalesce(F.sum("d").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counted = summed.where("point IS NOT NULL").join(F.broadcast(opened), "cell").select("point.*", (F.col("before") + F.col("inside")).alias("n"))
    return counted.where("n > 0")


def window_totals(points: DataFrame, windows: DataFrame, key: str, at: str, low: str, value: str, seconds: int) -> DataFrame:
    """key, and as n and total the count of points and the sum of their values with low <= at < low + seconds, over all windows of a key; only where there are points.

    No pairs are made, so work grows with the rows of both sides however many points a window holds. Time is cut into cells
    as long as a window, so a window is the end of one cell and the start of the next: two running sums, one of them
    backwards. Nothing is subtracted, so NULLs, NaN and infinity in values count as in a plain sum. A task sums a cell at a time.
    """
    width = seconds * 1_000_000
    cell = F.expr(f"(t - pmod(t, {width}L)) div {width}L AS cell")  # whole numbers: a double can't hold all microseconds
    ends = [F.struct((F.col("t") + after).alias("t"), F.lit(after > 0).alias("ends")) for after in (0, width)]
    marks = windows.select(key, _micros(windows, low).alias("t")).where("t IS NOT NULL").select(key, F.inline(F.array(*ends)))
    marks = marks.select(cell, "t", F.lit(0).alias("one"), F.lit(None).cast("double").alias("v"), F.col(key).alias("key"), "ends")
    placed = points.select(_micros(points, at).alias("t"), F.col(value).alias("v")).where("t IS NOT NULL")
    both = placed.select(cell, "t", F.lit(1).alias("one"), "v").unionByName(marks, allowMissingColumns=True)
    # a mark comes before the points of its time, backwards after them
    forward = Window.partitionBy("cell").orderBy("t", "one").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("cell").orderBy(F.desc("t"), F.desc("one")).rowsBetween(Window.unboundedPreceding, 0)
    over = lambda w: F.struct(F.sum("one").over(w).alias("n"), F.sum("v").over(w).alias("total"))
    parts = both.select("key", "ends", "one", over(forward).alias("f"), over(backward).alias("b")).where("one = 0").select("key", F.expr("if(ends, f, b)").alias("part"))
    return parts.groupBy(F.col("key").alias(key)).agg(F.sum("part.n").alias("n"), F.sum("part.total").alias("total")).where("n > 0")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, rows: int = 6000) -> DataFrame:
    """Pairs of a row of left and one of right that meet a condition without equality.

    Every pair must be tested, so the work is the product of both sides. Each side is dealt by hash into parts of about `rows` rows;
    a part of left meets a part of right in one task's cell, so tasks grow in number, not in length, and none
    holds more than the parts of its cells. Equal rows share a part.
    """
    parts = [max(1, -(-side.count() // rows)) for side in (left, right)]
    dealt = []
    for side, own, other in ((left, 0, 1), (right, 1, 0)):
        numbered = side.withColumn(f"quern_{own}", F.pmod(F.xxhash64(*side.columns), F.lit(parts[own])).cast("int"))
        dealt.append(numbered.withColumn(f"quern_{other}", F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1)))).repartition(parts[0] * parts[1], "quern_0", "quern_1"))
    return dealt[0].join(dealt[1], ["quern_0", "quern_1"]).where(condition).drop("quern_0", "quern_1")


def anti_not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is NOT IN right's, with SQL's three values.

    Nothing on the right: every row. A NULL on the right: none. Else rows with a key that has no match. Spark's own plan
    broadcasts the whole right side for this; here one row of counts is, and the rest is a plain anti join.
    """
    counts = right.agg(F.count(F.lit(1)).alias("quern_n"), F.count_if(F.col(right_key).isNull()).alias("quern_nulls"))
    kept = left.join(right.select(F.col(right_key).alias("quern_key")), F.col(left_key) == F.col("quern_key"), "left_anti")
    may = (F.col("quern_n") == 0) | (F.col("quern_nulls") == 0) & F.col(left_key).isNotNull()
    return kept.crossJoin(F.broadcast(counts)).where(may).drop("quern_n", "quern_nulls")


def global_ranks(rows: DataFrame, key: str) -> DataFrame:
    """rows and rank, dense_rank, percent_rank, cume_dist of key over all of them.

    Only the distinct keys with their counts are put in order in one task; rows are joined to them.
    """
    counts = rows.groupBy(F.col(key).alias("quern_key")).agg(F.count(F.lit(1)).alias("quern_n"))
    order = Window.orderBy("quern_key")
    upto = F.sum("quern_n").over(order)
    every = F.sum("quern_n").over(Window.partitionBy())
    before = upto - F.col("quern_n")
    placed = counts.select(
        "quern_key", (before + 1).alias("rank"), F.row_number().over(order).cast("long").alias("dense_rank"), F.when(every > 1, before / (every - 1)).otherwise(0.0).alias("percent_rank"), (upto / every).alias("cume_dist")
    )
    return rows.join(placed, F.col(key).eqNullSafe(F.col("quern_key"))).drop("quern_key")


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """An equi-join whose hot keys are spread over `salts` partitions: the small side is repeated for each.

    Rows stay whole: every row of big meets every row of small with its key once.
    Only for joins that keep rows of big (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}")
    spread = big.withColumn("quern_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("quern_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [key, "quern_salt"], how).drop("quern_salt")
