"""Identity, clamp, sliding mean and sliding median."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.mathx import clamp


def identity(section: str, params: tuple) -> Column:
    """No transformation: the processed value is the raw value."""
    from veilstream.operators.pets import section_value
    return section_value(section)


def clamped(section: str, params: tuple) -> Column:
    low, high = params
    return clamp(F.col("scalar"), low, high)


def sliding_mean(section: str, params: tuple):
    """Mean of the last ``size`` speeds; ready once the frame is full."""
    from veilstream.operators.pets import WindowPet
    (size,) = params

    def compute(rows, ordered, whole, prefix):
        frame = ordered.rowsBetween(-(size - 1), 0)
        mean, count = f"{prefix}mean", f"{prefix}count"
        rows = rows.withColumns({mean: F.avg("scalar").over(frame),
                                 count: F.count(F.lit(1)).over(frame)})
        return rows, F.col(mean), F.col(count) == size

    def of_recent(recent):
        total = F.aggregate(recent, F.lit(0.0), lambda acc, r: acc + r["scalar"])
        return total / F.size(recent), F.size(recent) == size

    return WindowPet(size, ("scalar",), compute, of_recent)


def sliding_median(section: str, params: tuple):
    """Median of the last ``size`` speeds, the lower middle for even sizes; ready once full."""
    from veilstream.operators.pets import WindowPet
    (size,) = params

    def compute(rows, ordered, whole, prefix):
        frame = ordered.rowsBetween(-(size - 1), 0)
        held, count = f"{prefix}held", f"{prefix}count"
        rows = rows.withColumns({held: F.collect_list("scalar").over(frame),
                                 count: F.count(F.lit(1)).over(frame)})
        return rows, lower_middle(F.col(held)), F.col(count) == size

    def of_recent(recent):
        return lower_middle(F.transform(recent, lambda r: r["scalar"])), F.size(recent) == size

    return WindowPet(size, ("scalar",), compute, of_recent)


def lower_middle(values: Column) -> Column:
    """Median of an array, the lower of the two middle values for even sizes."""
    middle = F.floor((F.size(values) + 1) / 2).cast("int")
    return F.try_element_at(F.sort_array(values), middle)
