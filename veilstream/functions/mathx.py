"""Scalar helpers as Columns: clamp, rounding, entropy, Beta parameters, seeded uniforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    """``value`` limited to ``[low, high]``; null stays null."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, lo), hi))


def round_half_up(value: Column, decimals: int) -> Column:
    """Round to ``decimals`` places with halves going toward positive infinity."""
    scale = F.lit(float(10 ** decimals))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def percent_text(share: Column, decimals: int) -> Column:
    """A share as percent text with at most ``decimals`` decimals, e.g. 0.125 -> ``12.5\\%``.

    The text is meant for typeset tables: the percent sign comes with a backslash, a number below
    one has no leading zero, trailing zeros are dropped. Halves go to the even neighbour. With
    ``decimals`` 0 the decimal point stays.
    """
    percent = F.bround(share * 100, decimals)
    text = F.format_string(f"%.{decimals}f", F.abs(percent))
    if decimals:
        text = F.regexp_replace(text, r"\.?0+$", "")
        text = F.regexp_replace(text, r"^0\.", ".")
        text = F.when(text == "", F.lit("0")).otherwise(text)
    else:
        text = F.concat(text, F.lit("."))
    sign = F.when(share < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(share.isNotNull(), F.concat(sign, text, F.lit("\\%")))


def entropy_terms(p: Column) -> Column:
    """One summand of the base-2 Shannon entropy; non-positive shares count as zero."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def entropy(p: Column) -> Column:
    """Aggregate form: entropy of the shares in the group."""
    return F.sum(entropy_terms(p))


def entropy_of(shares: Column) -> Column:
    """Array form: entropy of the shares in an ``array<double>``."""
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + entropy_terms(p))


def beta_parameters(mode: Column, gamma: Column) -> Column:
    """``struct(a, b)`` of the Beta distribution with the given mode; the heavier side gets ``gamma``.

    With ``q`` the distance of the mode to its nearer end, the lighter parameter is
    ``1 + q * (gamma - 1) / (1 - q)``.
    """
    low_side = mode <= 0.5
    q = F.when(low_side, mode).otherwise(1 - mode)
    lighter = 1 + q * (gamma - 1) / (1 - q)
    return F.struct(
        F.when(low_side, lighter).otherwise(gamma).alias("a"),
        F.when(low_side, gamma).otherwise(lighter).alias("b"),
    )


def beta_shape(mode, gamma):
    """``beta_parameters`` for Python numbers and NumPy arrays."""
    q = np.minimum(mode, 1 - mode)
    lighter = 1 + q * (gamma - 1) / (1 - q)
    return np.where(mode <= 0.5, lighter, gamma), np.where(mode <= 0.5, gamma, lighter)


def row_seed(seed, *identity: Column) -> Column:
    """A 60-bit seed from the row's identity: the same row gets the same draws in any partitioning."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", first, *[c.cast("string") for c in identity])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(seed, *identity: Column) -> Column:
    """A uniform number in (0, 1) from the row's identity, never 0 or 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in identity])
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / F.lit(4294967296.0)


def laplace_from_uniform(u: Column, location: Column, scale: Column) -> Column:
    """Laplace quantile; a scale of zero gives the location itself."""
    centred = u - 0.5
    return location - scale * F.signum(centred) * F.log(1 - 2 * F.abs(centred))
