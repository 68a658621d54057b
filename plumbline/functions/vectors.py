"""Vector expressions with NumPy's rules for NaN, which differ from Spark's: NaN equals nothing and exceeds nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def widen(v: Column) -> Column:
    """Elements as doubles; a null element is NaN, a null vector stays null."""
    return F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_INF))


def unless_nan(x: Column) -> Column:
    """NaN as null, so that averages skip it and comparisons with it are not true."""
    return F.nanvl(x, F.lit(None).cast("double"))


def same(a: Column, b: Column) -> Column:
    """Every element equal, bit for bit but for the sign of zero; NaN differs from itself."""
    return F.forall(F.zip_with(a, b, lambda p, q: (p == q) & ~F.isnan(p)), lambda x: F.coalesce(x, F.lit(False)))


def close(a: Column, b: Column, share: float = 1e-5) -> Column:
    """Every element within `share` of b's; the tolerance follows b alone. Equal infinities are close."""

    def one(p: Column, q: Column) -> Column:
        return ((p == q) & ~F.isnan(p)) | (finite(p) & finite(q) & (F.abs(p - q) <= F.lit(share) * F.abs(q)))

    return F.forall(F.zip_with(a, b, one), lambda x: F.coalesce(x, F.lit(False)))


def rounded(v: Column, places: int = 4) -> Column:
    """Half to even on the scaled double, as array rounding does; not on the decimal digits."""
    scale = float(10**places)
    return F.transform(v, lambda x: F.rint(x * F.lit(scale)) / F.lit(scale))


def clamp_step(now: Column, target: Column, most: float) -> Column:
    """The target, but no element further than `most` from now."""
    return F.zip_with(now, target, lambda n, t: n + F.greatest(F.least(t - n, F.lit(most)), F.lit(-most)))


def norm(v: Column, first: int = 3) -> Column:
    return F.sqrt(F.aggregate(F.slice(v, 1, first), F.lit(0.0), lambda s, x: s + x * x))


def clip_unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
