"""Ordered windows over keys of any size.

A plain ``Window.partitionBy(vehicle).orderBy(time)`` puts all rows of a vehicle into one task. That
is the right plan for ordinary vehicles (one exchange, shared by every window on the same key) and
the wrong one for a key that holds a large part of the table.

``plan_slices`` counts rows per key in one column-pruned, map-side combined pass and picks the keys
above ``target_rows``, a null key included. Their time axis is cut at quantiles of their own rows, so
slices have about that size wherever the rows lie. Every operator here runs ordinary keys as plain
windows and hot keys per ``(keys, slice)``; what a slice needs from the slices before it (a last value,
a running total, a few trailing rows) is computed from small summaries per slice and placed in front of
the slice as *seed rows*. Results do not depend on where the cuts are. The hot rows are written to the
shared folder before each such step, because the step reads them twice; steps in a row therefore cost
their sum. ``by_heat`` splits the rows of a whole pipeline once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veilstream.session import cut_lineage, if_small

TARGET_ROWS = 5_000_000
SALTS = 64  # parts of a hot key while it meets a table of cuts that cannot be broadcast
BLOCK = 256  # quantiles of one aggregate; more slices than that come from a second one per interval


@dataclass(frozen=True)
class SlicePlan:
    """Cuts on the time axis of the hot keys; empty when no key is hot.

    ``cuts`` has the key, ``_firsts`` (where its blocks of cuts begin) and ``_blocks`` (the cuts of each
    block); ``broadcast`` tells that it was counted and is small. ``only_hot`` tells that all rows are of hot
    keys and have their slice already.
    """

    key: str
    time: str
    cuts: DataFrame | None = None
    only_hot: bool = False
    broadcast: bool = False

    @property
    def sliced(self) -> bool:
        return self.cuts is not None

    @property
    def plain(self) -> SlicePlan:
        return SlicePlan(self.key, self.time)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``_slice`` (0 for ordinary keys) and ``_hot``; ``_slice`` never falls with time.

        Rows that have them keep them: a pipeline assigns slices once, before it multiplies rows. What is
        put together from several tables needs ``align`` first; a row without its slice is an error.
        """
        if not self.sliced:
            return df
        if "_slice" in df.columns:
            lacking = F.raise_error(F.lit("a row has no slice: align() both sides of a union"))
            return df.withColumns({"_slice": F.coalesce("_slice", lacking.cast("long")),
                                   "_hot": F.coalesce("_hot", lacking.cast("boolean"))})
        t = F.col(self.time)
        if self.broadcast:
            joined = join_null_safe(df, self.cuts, [self.key], "left")
        else:  # too large a table: readings of a hot key are dealt out before they meet its cuts
            salted = self.cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = df.withColumn("_salt", F.pmod(F.xxhash64(t), F.lit(SALTS)).cast("int"))
            joined = join_null_safe(rows, salted, [self.key, "_salt"], "left").drop("_salt")
        block = F.greatest(F.size(F.filter("_firsts", lambda c: c <= t)), F.lit(1))
        inner = F.size(F.filter(F.element_at("_blocks", block), lambda c: c <= t))
        place = block.cast("long") * F.lit(1 << 32) + inner
        return (joined.withColumn("_hot", F.col("_firsts").isNotNull())
                .withColumn("_slice", F.when(F.col("_hot"), place).otherwise(F.lit(0).cast("long")))
                .drop("_firsts", "_blocks"))

    def align(self, df: DataFrame, like: DataFrame) -> DataFrame:
        """Give ``df`` slices if ``like``, which it will be put together with, has them."""
        if not self.sliced or "_slice" not in like.columns or "_slice" in df.columns:
            return df
        assigned = replace(self, only_hot=False).assign(df)
        # Rows of ordinary keys have no place among rows of hot ones.
        return assigned.where("_hot") if self.only_hot else assigned


def plan_slices(df: DataFrame, key: str = "vehicle_id", time: str = "generate_ms",
                target_rows: int = TARGET_ROWS, copies: int = 1) -> SlicePlan:
    """Find the keys that need slicing and cut them. ``copies`` is how often a pipeline multiplies rows
    before its windows (applications, sections): slices are made so much smaller.

    One aggregate over the key, and, only where a key is hot, a few more over the hot keys. Keys and cuts stay in
    a table, which is broadcast if it was counted and is small."""
    target = max(1, target_rows // copies)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0
    if largest <= target:
        return SlicePlan(key, time)
    most = -(-largest // target)
    hot, _ = if_small(cut_lineage(counts.where(F.col("_n") > target).select(
        F.col(key).alias("_key"), F.ceil(F.col("_n") / target).alias("_parts"))))
    rows = df.select(F.col(key).alias("_of"), F.col(time).alias("_t"))
    rows = rows.join(hot, rows["_of"].eqNullSafe(hot["_key"])).select("_key", "_parts", "_t")

    def spread(points: Column, wanted: Column, have: int) -> Column:
        """``wanted`` of ``have`` quantiles, evenly, without repetitions."""
        steps = F.sequence(F.lit(0), F.greatest(wanted, F.lit(1)).cast("int") - 1)
        return F.array_sort(F.array_distinct(F.transform(
            steps, lambda i: F.element_at(points, F.floor(i * have / wanted).cast("int") + 1))))

    count = int(min(BLOCK, most))
    quantiles = F.percentile_approx("_t", [i / count for i in range(count)], 10_000)
    wide = F.least(F.col("_parts"), F.lit(count))
    firsts = (rows.groupBy("_key", "_parts").agg(quantiles.alias("_q"))
              .select("_key", "_parts", spread(F.col("_q"), wide, count).alias("_firsts")))
    if most <= BLOCK:
        cuts = firsts.select("_key", F.slice("_firsts", 1, 1).alias("_firsts"), F.array("_firsts").alias("_blocks"))
    else:
        firsts = cut_lineage(firsts)
        inner = -(-int(most) // BLOCK)
        points = F.percentile_approx("_t", [i / inner for i in range(inner)], max(10_000, 40 * inner))
        named = firsts.select(F.col("_key").alias("_of"), "_firsts")
        at = F.greatest(F.size(F.filter("_firsts", lambda c: c <= F.col("_t"))), F.lit(1))
        blocks = (rows.join(named, rows["_key"].eqNullSafe(named["_of"])).groupBy("_key", "_parts", at.alias("_at"))
                  .agg(points.alias("_q"), F.min("_t").alias("_first")))
        fine = F.least(F.ceil(F.col("_parts") / BLOCK), F.lit(inner))
        blocks = blocks.select("_key", F.struct("_first", spread(F.col("_q"), fine, inner).alias("_cuts")).alias("_b"))
        cuts = (blocks.groupBy("_key").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
                .select("_key", F.col("_b._first").alias("_firsts"), F.col("_b._cuts").alias("_blocks")))
    cuts = cut_lineage(cuts.withColumnRenamed("_key", key))
    cells = F.aggregate("_blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(b))
    cuts, small = if_small(cuts, cells)
    return SlicePlan(key, time, cuts, broadcast=small)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null equals null; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_on_{k}" for k in keys])


def by_heat(df: DataFrame, plan: SlicePlan, run: Callable[[DataFrame, SlicePlan], DataFrame]) -> DataFrame:
    """``run(rows, plan)`` on the rows of ordinary keys with plain windows, and on those of hot keys slice
    by slice; the rows are split and the hot ones written once."""
    if not plan.sliced or plan.only_hot:
        return run(df, plan)
    given, rows = df.columns, plan.assign(df)
    hot = cut_lineage(rows.where("_hot"))
    cold = rows.where(~F.col("_hot")).drop(*[c for c in ("_slice", "_hot") if c not in given])
    ordinary = run(cold, plan.plain)
    sliced = run(hot, replace(plan, only_hot=True))
    return ordinary.unionByName(sliced.drop(*[c for c in ("_slice", "_hot") if c not in given]), allowMissingColumns=True)


class Timeline:
    """Ordered computations per ``keys``, ordered by ``order`` (first column: the time column)."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], plan: SlicePlan):
        if plan.sliced and (plan.key not in keys or plan.time != order[0]):
            raise ValueError(f"slices by ({plan.key}, {plan.time}) do not fit "
                             f"keys {list(keys)} ordered by {list(order)}")
        self.keys = list(keys)
        self.order = list(order)
        self.plan = plan

    def window(self) -> WindowSpec:
        extra = ["_slice"] if self.plan.sliced else []
        # Seed rows have no order values; nulls come first.
        return Window.partitionBy(*self.keys, *extra).orderBy(*[F.asc_nulls_first(c) for c in self.order])

    def _split(self, df: DataFrame, run: Callable[[Timeline, DataFrame], DataFrame]) -> DataFrame:
        return by_heat(df, self.plan, lambda rows, plan: run(Timeline(self.keys, self.order, plan), rows))

    def last_known(self, df: DataFrame, values: Mapping[str, Column],
                   inclusive: bool = True) -> DataFrame:
        """Carry forward: the last non-null value up to (or strictly before) each row."""
        return self._split(df, lambda line, rows: line._last_known(rows, values, inclusive))

    def _last_known(self, df, values, inclusive) -> DataFrame:
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if not self.plan.sliced:
            return df.withColumns({name: F.last(v, ignorenulls=True).over(frame)
                                   for name, v in values.items()})
        hidden = {f"_v_{name}": v for name, v in values.items()}
        rows = cut_lineage(self.plan.assign(df).withColumns(hidden))
        position = F.struct(*self.order)
        summary = self._summary(rows, [
            F.max_by(name, F.when(F.col(name).isNotNull(), position)).alias(name) for name in hidden])
        before = self._slices_before()
        seeds = summary.select(*self.keys, "_slice", F.lit(True).alias("_seed"),
                               *[F.last(name, ignorenulls=True).over(before).alias(name)
                                 for name in hidden])
        out = self._with_seeds(rows, seeds).withColumns(
            {name: F.last(f"_v_{name}", ignorenulls=True).over(frame) for name in values})
        return self._clean(out, hidden)

    def running_sum(self, df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        """Running totals, including the current row, of the type that a sum of the values has."""
        return self._split(df, lambda line, rows: line._running_sum(rows, values))

    def _running_sum(self, df, values) -> DataFrame:
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.plan.sliced:
            return df.withColumns({name: F.sum(v).over(frame) for name, v in values.items()})
        hidden = {f"_v_{name}": v for name, v in values.items()}
        rows = self.plan.assign(df).withColumns(hidden)
        kinds = dict(rows.groupBy().agg(*[F.sum(name).alias(name) for name in hidden]).dtypes)
        rows = cut_lineage(rows.withColumns({name: F.col(name).cast(kinds[name]) for name in hidden}))
        summary = self._summary(rows, [F.sum(name).alias(name) for name in hidden])
        before = self._slices_before()
        seeds = summary.select(*self.keys, "_slice", F.lit(True).alias("_seed"),
                               *[F.sum(name).over(before).cast(kinds[name]).alias(name) for name in hidden])
        out = self._with_seeds(rows, seeds).withColumns(
            {name: F.sum(f"_v_{name}").over(frame).cast(kinds[f"_v_{name}"]) for name in values})
        return self._clean(out, hidden)

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """Row number from 1, per keys."""
        if not self.plan.sliced:
            return df.withColumn(name, F.row_number().over(self.window()).cast("long"))
        return self.running_sum(df, {name: F.lit(1)})

    def last_rows(self, df: DataFrame, size: int, columns: Sequence[str],
                  compute: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame]) -> DataFrame:
        """Columns over the frame of the last ``size`` rows including the current one.

        ``compute(rows, ordered, whole)`` adds the columns. ``ordered`` is the window without a frame
        (the caller sets ``rowsBetween(-(n - 1), 0)`` with ``n <= size``), ``whole`` the unordered
        partition; ``columns`` names the inputs that it reads.
        """
        return self._split(df, lambda line, rows: line._last_rows(rows, size, columns, compute))

    def _last_rows(self, df, size, columns, compute) -> DataFrame:
        whole = Window.partitionBy(*self.keys, *(["_slice"] if self.plan.sliced else []))
        if not self.plan.sliced:
            return compute(df, self.window(), whole)
        rows = cut_lineage(self.plan.assign(df))
        keep = max(size - 1, 1)
        needed = list(dict.fromkeys([*self.order, *columns]))
        latest = (Window.partitionBy(*self.keys, "_slice")
                  .orderBy(*[F.desc_nulls_last(c) for c in self.order]))
        tails = (rows.select(*self.keys, "_slice", *[c for c in needed if c not in self.keys])
                 .withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= keep))
        # `_end` is the number of rows up to the end of a slice. A slice needs the rows numbered from
        # its start - keep on; they lie in the slices before it that end behind that number.
        sizes = self._summary(rows, [F.count(F.lit(1)).alias("_rows")])
        upto = Window.partitionBy(*self.keys).orderBy("_slice")
        ends = sizes.withColumn("_end", F.sum("_rows").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        start = F.col("_end") - F.col("_rows")
        wanted = (ends.withColumn("_near", F.collect_list(F.struct(F.col("_slice").alias("s"), F.col("_end").alias("e")))
                                  .over(upto.rowsBetween(-keep, -1)))
                  .select(*self.keys, F.col("_slice").alias("_for"), start.alias("_start"), F.explode("_near").alias("_near"))
                  .select(*self.keys, "_for", F.col("_near.s").alias("_slice"),
                          (F.col("_near.e") - F.col("_start") + keep).alias("_take")).where("_take > 0"))
        on = [tails["_slice"] == wanted["_slice"], *(tails[k].eqNullSafe(wanted[k]) for k in self.keys)]
        halo = (tails.join(wanted, on).where(F.col("_back") <= F.col("_take"))
                .select(*[tails[c] for c in dict.fromkeys([*self.keys, *needed])],
                        F.col("_for").alias("_slice"), F.lit(True).alias("_seed")))
        return self._clean(compute(self._with_seeds(rows, halo), self.window(), whole), [])

    def _summary(self, rows: DataFrame, aggregates: list[Column]) -> DataFrame:
        return rows.groupBy(*self.keys, "_slice").agg(*aggregates)

    def _slices_before(self) -> WindowSpec:
        return (Window.partitionBy(*self.keys).orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, -1))

    def _with_seeds(self, rows: DataFrame, seeds: DataFrame) -> DataFrame:
        return rows.unionByName(seeds, allowMissingColumns=True)

    def _clean(self, out: DataFrame, hidden) -> DataFrame:
        return out.where(F.col("_seed").isNull()).drop("_seed", *hidden)
