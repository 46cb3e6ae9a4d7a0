"""Small column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest value of hash52 plus one.
HASH_SPACE = float(2**52)


def hash52(*parts: Column | str | int) -> Column:
    """A 52-bit hash of the parts joined by ':' (first 13 hex digits of MD5).

    A pure function of its input, so samples and draws built on it do not depend
    on partitioning, and any SQL engine with MD5 can recompute it.
    """
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once per row.

    Spark does not share sub-expressions inside lambdas: without this, a lambda
    over token positions would run the tokenising regex again for every position.
    """
    return F.transform(F.array(value), body)[0]


def exact_mean(value: Column) -> Column:
    """The mean of doubles, the same in whatever order and parts they are added.

    Terms are added as decimals of 12 places. Means of values on a coarse grid, such
    as scores of one decimal, often lie on a rounding edge, where the order of
    floating-point additions would decide. NaN, infinite and huge terms make it a
    plain mean.
    """
    fits = F.abs(value) < 1e15
    odd = F.count_if(~fits)
    return F.when(odd > 0, F.avg(value)).otherwise(F.avg(F.when(fits, value).cast("decimal(38,12)")).cast("double"))


def fixed3(value: Column) -> Column:
    """A double with three decimals, rounded half-even on its exact binary value.

    This is C printf rounding. `format_string('%.3f')` rounds half-up on the
    shortest decimal form, so it turns 0.0625 into 0.063 instead of 0.062.
    The product with 2000 is split in two exact halves to see on which side of
    the rounding tie the value lies.
    """
    x = value.cast("double")
    size = F.abs(x)
    whole = F.floor(size * 1000).cast("bigint")
    high = size * 134217729.0 - (size * 134217729.0 - size)
    beyond = (high * 2000 - (whole * 2 + 1)) + (size - high) * 2000
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 == 1))
    thousandths = whole + up.cast("bigint")
    # Only a negative number, zero among them, starts with a minus as text.
    digits = F.concat(
        F.when(x.cast("string").startswith("-"), "-").otherwise(""),
        F.floor(thousandths / 1000).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((thousandths % 1000).cast("string"), 3, "0"),
    )
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when(size < 1e12, digits)
        .otherwise(F.format_string("%.3f", x))
    )
