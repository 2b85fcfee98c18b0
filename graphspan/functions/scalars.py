"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def accuracy(correct: Column, count: Column) -> Column:
    """Share of correct, 1 if there is nothing to count."""
    return F.when(count == 0, 1.0).otherwise(correct / count)


def wrap_in_range(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def linear_interpolate(a: Column, low: float, high: float) -> Column:
    return F.lit(low) + a * (high - low)


def exp_interpolate(a: Column, low: float, high: float) -> Column:
    """Moves by equal factors from low to high as a goes from 0 to 1."""
    return F.lit(low) * F.pow(F.lit(high / low), a)


def gaussian_fourth_order(x: Column, half: float) -> Column:
    return F.pow(F.lit(2.0), -F.pow(x / half, F.lit(4.0)))


def digits(n: Column, base: int) -> Column:
    """Digits of a natural number of 64 bits in any base from 2, most significant first; [0] for 0."""
    start = F.struct(n.cast("long").alias("rest"), F.array().cast("array<bigint>").alias("out"))
    most = math.ceil(64 / math.log2(base))
    step = lambda s: F.struct(F.call_function("div", s["rest"], F.lit(base)).alias("rest"), F.concat(F.array(s["rest"] % base), s["out"]).alias("out"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda s, _: F.when(s["rest"] > 0, step(s)).otherwise(s), lambda s: s["out"])
    return F.when(n == 0, F.array(F.lit(0).cast("long"))).otherwise(found)


def pretty_time(nanos: Column, places: int = 3) -> Column:
    """With the largest unit of h, s, ms, µs, ns that it exceeds one of."""
    steps = [(3600e9, "h"), (1e9, "s"), (1e6, "ms"), (1e3, "µs")]
    out = F.format_string(f"%.{places}fns", nanos.cast("double"))
    for size, unit in reversed(steps):
        out = F.when(nanos > size, F.format_string(f"%.{places}f{unit}", nanos / size)).otherwise(out)
    return out


def anneal_log(t0: float, k: Column) -> Column:
    return F.lit(t0) * F.log(F.lit(2.0)) / F.log(k + 1)


def anneal_exp(t0: float, gamma: float, k: Column) -> Column:
    return F.lit(t0) * F.pow(F.lit(gamma), k - 1)


def anneal_fast(t0: float, k: Column) -> Column:
    return F.lit(t0) / k


def learning_rate_scale(epoch: Column, epochs: int) -> Column:
    return F.greatest(F.lit(0.3), 1 - 0.7 * epoch / epochs)


def sampling_key(seed: int, key: Column) -> Column:
    """Text to order by in place of a random shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))


def safe_abs(x: Column) -> Column:
    """Absolute value of a 32-bit integer; 0 for the least one, which has none."""
    return F.when(x == -(1 << 31), F.lit(0)).otherwise(F.abs(x))


def nearly_equal(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= 1e-8


def aggressive_sigmoid(x: Column, aggressiveness: float) -> Column:
    """A curve on [0, 1] that is the identity for 0.5 and rises ever earlier up to 1."""
    return F.pow(x, F.lit(50 ** (2 * (0.5 - aggressiveness))))


def aggressive_interpolate(x: Column, aggressiveness: float, low: float, high: float) -> Column:
    return linear_interpolate(aggressive_sigmoid(x, aggressiveness), low, high)


def in_quotes(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def source_text(text: Column, line: Column, start: Column, until_line: Column, until: Column) -> Column:
    """What a zero-based span covers: within a line its columns, over several the first line's rest and three dots."""
    first = F.get(F.split(text, "\n", -1), line)
    return F.when(line == until_line, F.substring(first, start + 1, until - start)).otherwise(F.concat(F.substring(first, start + 1, F.length(first)), F.lit(" ...")))


def mean_and_spread(mean: Column, spread: Column) -> Column:
    """mean±deviation, with as many decimals as the deviation needs to show two of its digits."""
    decimals = F.greatest(F.lit(0), 1 - F.floor(F.log10(spread)).cast("int"))
    text = lambda x: F.coalesce(*[F.when(decimals == d, F.format_string(f"%.{d}f", x)) for d in range(8)], F.format_string("%.8f", x))
    return F.when(spread > 0, F.concat(text(mean), F.lit("±"), text(spread))).otherwise(F.concat(mean.cast("string"), F.lit("±0")))
