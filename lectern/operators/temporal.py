"""Joins over time and over ranges of values: as-of, interval, range and band joins, as equi joins and windows.

None of them has a nested loop in its plan: rows meet on whole buckets of time or value, so Spark hashes and sorts them as in any equi join. Buckets
with many rows on both sides are cut into tiles of pairs (_met).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of one key that an as-of join means to keep in one slice of time.
SLICE_ROWS = 1_000_000
#: A key with more than TILE * TILE pairs of rows is cut into tiles of so many, TILE rows by TILE rows where it has these on both sides; tiles of a task, tasks at most.
TILE, TASK_TILES, MOST_TASKS = 1024, 8, 20_000


def _micros(c: Column, kind: str) -> Column:
    """A time or number as something that can be divided: whole microseconds, or the number itself."""
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind in ("timestamp_ntz", "date"):
        return F.unix_micros(c.cast("timestamp"))
    return c


def _slice_width(rows: DataFrame, slice_rows: int) -> float | None:
    """Width of slices in which a key of average spread has about slice_rows rows, None if one slice does: one aggregate over both sides."""
    r = rows.agg(F.count("*").alias("n"), F.min("_at").cast("double").alias("a"), F.max("_at").cast("double").alias("b")).first()
    slices = -(-r["n"] // slice_rows)
    return None if slices < 2 or r["b"] == r["a"] else (r["b"] - r["a"]) / slices


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    tolerance=None,
    direction: str = "backward",
    exact: bool = True,
    tie: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every row of left with `values` of the right row of the same keys that is latest at its time (with direction "forward", next).

    Both sides are laid together and the last right row is carried along each key's time, so a key's rows meet in one sort and no pairs arise.
    With more than slice_rows rows, time is cut into slices: each key and slice is a window of its own, and the last right row before
    a slice is found among one row per key and slice and put at its head, so a key that holds most rows is sorted in many tasks.

    exact takes right rows at the very time. tolerance, in the times' own difference (an interval for timestamps, a number for numbers), leaves out
    right rows further away. Right rows at the same time go by `tie`, the last counts, then by their values. Keys that are null on
    either side and null times match nothing; such left rows stay, with null values.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction!r}")
    forward = direction == "forward"
    l_kind, r_kind = left.schema[left_time].dataType.typeName(), right.schema[right_time].dataType.typeName()
    at = lambda c, kind: -_micros(c, kind) if forward else _micros(c, kind)
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    names = [f"_k{i}" for i in range(len(on))]
    carried = F.struct(F.col(right_time).alias("_time"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    tied = F.struct(*([F.col(t) for t in tie or []] or [F.lit(0)]))
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*on, right_time]])
    r = right.filter(usable).select(*keys, at(F.col(right_time), r_kind).alias("_at"), F.lit(0 if exact else 2).alias("_side"), tied.alias("_tie"), carried.alias("_found"))
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row")
    some = left.select(*keys, at(F.col(left_time), l_kind).alias("_at"), F.lit(1).alias("_side"), row)
    both = r.unionByName(some, allowMissingColumns=True)
    width = _slice_width(both, slice_rows)
    if width is None:
        both = both.withColumn("_slice", F.lit(0).cast("long"))
    else:
        both = both.withColumn("_slice", F.floor(F.col("_at") / F.lit(width)))
        order = F.struct("_at", "_tie", "_found")
        ends = both.filter("_found IS NOT NULL").groupBy(*names, "_slice").agg(F.max(order).alias("_last"))
        # one row for each key and slice that has some: the right rows' ends, carried to the next slice of the key
        used = both.select(*names, "_slice").distinct().join(ends, [*names, "_slice"], "left")
        before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        heads = used.withColumn("_head", F.last("_last", ignorenulls=True).over(before)).filter("_head IS NOT NULL")
        heads = heads.select(*names, F.lit(-1).alias("_side"), F.col("_head._at").alias("_at"), F.col("_head._tie").alias("_tie"), F.col("_head._found").alias("_found"), "_slice")
        both = both.unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*names, "_slice").orderBy("_at", "_side", "_tie", "_found").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("_match", F.last("_found", ignorenulls=True).over(w)).filter("_row IS NOT NULL")
    known = F.col(f"_row.`{left_time}`").isNotNull() & reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    if tolerance is not None:
        a, b = F.col(f"_row.`{left_time}`"), F.col("_match._time")
        far = (b - a if forward else a - b) > (tolerance if isinstance(tolerance, Column) else F.lit(tolerance))
        known = known & ~F.coalesce(far, F.lit(False))
    taken = [v if v not in left.columns else f"{v}_right" for v in values]
    return joined.select("_row.*", *(F.when(known, F.col(f"_match._v{i}")).alias(n) for i, n in enumerate(taken)))


def _met(left: DataFrame, right: DataFrame, keys: list[str], tile: int | None = None) -> DataFrame:
    """left and right joined on keys, which no task gets more than a few tiles of pairs of, however many rows a key has.

    A key's pairs grow with the product of its rows, so few keys, or a small side that every task of the other one gets whole, leave the work to few
    tasks. Rows of each key are counted on both sides; in heavy keys a row goes to one tile of its own side, by chance, and to all of the other,
    so that each pair meets once. A heavy key has 2 * tile rows at least, so the table of them is short.
    """
    tile = tile or TILE
    counts = [side.groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for side, n in ((left, "_nl"), (right, "_nr"))]
    heavy = counts[0].join(counts[1], keys).filter(F.col("_nl") * F.col("_nr") > tile * tile)
    tiles = lambda own, other: F.ceil(F.col(own) / F.greatest(F.lit(tile), tile * tile / F.col(other)))
    heavy = heavy.select(*keys, tiles("_nl", "_nr").alias("_tl"), tiles("_nr", "_nl").alias("_tr"))
    n_tiles = heavy.agg(F.sum(F.col("_tl").cast("double") * F.col("_tr"))).first()[0]
    if n_tiles is None:
        return left.join(right, keys)
    tasks = min(max(int(n_tiles) // TASK_TILES, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    met_on = [*keys, "_tl_at", "_tr_at"]

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.join(F.broadcast(heavy), keys, "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(1).cast("long"))
        side = side.withColumn(f"{own}_at", F.floor(F.rand(1) * n(own)))
        side = side.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), n(other) - 1))).drop("_tl", "_tr")
        return side.repartition(tasks, *met_on)

    # by a shuffle of both sides: a broadcast of one leaves the pairs to the tasks that read the other
    return dealt(left, "_tl", "_tr").hint("merge").join(dealt(right, "_tr", "_tl"), met_on).drop("_tl_at", "_tr_at")


def _level(start: Column, end: Column, width: float) -> Column:
    """The least level whose buckets are as wide as the interval: it lies in two of them at most."""
    size = (end - start).cast("double") / F.lit(float(width))
    return F.when(size <= 1, 0).otherwise(F.ceil(F.log2(size))).cast("int")


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None, width: float = 1.0, closed: bool = True) -> DataFrame:
    """Pairs of rows of equal keys whose intervals overlap, each once; columns of both sides, so their names must differ but for the keys.

    Buckets double in width from level to level, starting at `width`, in the unit of the values (seconds for times). An interval belongs to the level of
    its own length, where it lies in at most two buckets, and its shadow to every longer level that occurs on the other side. Rows meet on (keys,
    level, bucket) at the level of the longer of the two, so long intervals are not cut into many pieces and short ones never
    meet in wide buckets. A pair that shares two buckets counts in the one where the overlap begins. Full buckets are cut (_met).

    closed intervals touch at equal ends; else they must share more than a point, and intervals without extent overlap nothing. Intervals with a null
    or reversed end, and rows with a null key, have no pairs.
    """
    on = on or []
    number = lambda df, c: (_micros(F.col(c), df.schema[c].dataType.typeName()) / 1_000_000 if df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col(c)).cast("double")

    def side(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        a, b = number(df, span[0]), number(df, span[1])
        df = df.filter(F.col(span[0]) <= F.col(span[1]))
        return df.select(*(F.col(k) for k in on), F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in on)).alias(name), a.alias(f"{name}_a"), b.alias(f"{name}_b"), _level(a, b, width).alias(f"{name}_level"))

    l, r = side(left, left_span, "_l"), side(right, right_span, "_r")  # noqa: E741
    levels = [[x[0] for x in df.select(c).distinct().collect()] for df, c in ((l, "_l_level"), (r, "_r_level"))]  # about 60 levels are the most there can be

    def placed(df: DataFrame, name: str, level: Column) -> DataFrame:
        df = df.withColumn("_level", level)
        step = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
        first, last = F.floor(F.col(f"{name}_a") / step), F.floor(F.col(f"{name}_b") / step)
        return df.select("*", first.alias(f"{name}_first"), F.explode(F.sequence(first, last)).alias("_bucket"))

    def upper(own: str, others: list[int], strictly: bool) -> Column:
        above = F.filter(F.array(*(F.lit(x) for x in sorted(others))), lambda x: x > F.col(own) if strictly else x >= F.col(own))
        return F.explode(above)

    touch = (F.col("_l_a") <= F.col("_r_b")) & (F.col("_r_a") <= F.col("_l_b"))
    if not closed:
        touch = (F.col("_l_a") < F.col("_r_b")) & (F.col("_r_a") < F.col("_l_b")) & (F.col("_l_a") < F.col("_l_b")) & (F.col("_r_a") < F.col("_r_b"))
    found = []
    for native, shadow, strictly in (("_l", "_r", False), ("_r", "_l", True)):
        own, other = (l, r) if native == "_l" else (r, l)
        wide = levels[0 if native == "_l" else 1]
        if not wide:
            continue
        near = placed(own, native, F.col(f"{native}_level"))
        far = placed(other, shadow, upper(f"{shadow}_level", wide, strictly))
        pairs = _met(near, far, [*on, "_level", "_bucket"]).filter(touch & (F.col("_bucket") == F.greatest("_l_first", "_r_first")))
        found.append(pairs.select(*on, "_l.*", "_r.*"))
    if not found:
        return l.join(r, on or F.lit(False)).filter(F.lit(False)).select(*on, "_l.*", "_r.*")
    return reduce(DataFrame.unionByName, found)


def range_join(points: DataFrame, ranges: DataFrame, point: str, span: tuple[str, str], on: list[str] | None = None, width: float = 1.0) -> DataFrame:
    """Points with each range of equal keys that holds them, ends included."""
    return interval_join(points, ranges, (point, point), span, on, width)


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, distance: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of equal keys whose values are at most `distance` apart (in seconds, for times), each once.

    Buckets are as wide as the distance: a left value meets the buckets beside its own, a right value only its own.
    """
    if distance <= 0:
        raise ValueError("the distance must be above 0; equal values are an equi join")
    on = on or []
    times = ("timestamp", "timestamp_ntz", "date")
    number = lambda df, c: _micros(F.col(c), df.schema[c].dataType.typeName()) / (1_000_000 if df.schema[c].dataType.typeName() in times else 1)
    own = F.floor(number(left, left_value) / distance)
    l = left.filter(F.col(left_value).isNotNull()).withColumns({"_x": number(left, left_value), "_bucket": F.explode(F.sequence(own - 1, own + 1))})  # noqa: E741
    r = right.filter(F.col(right_value).isNotNull()).withColumns({"_y": number(right, right_value), "_bucket": F.floor(number(right, right_value) / distance)})
    return _met(l, r, [*on, "_bucket"]).filter(F.abs(F.col("_x") - F.col("_y")) <= distance).drop("_x", "_y", "_bucket")
