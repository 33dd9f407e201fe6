"""Expressions over numeric array columns: constructors, arithmetic, statistics, ordering.

Arrays are `array<double>` unless said otherwise; f32 values are widened before arithmetic. All are
built-in expressions, so they run in the JVM and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return col(x).cast("array<double>")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once for a row, even where fn uses it inside lambdas."""
    return F.aggregate(F.array(F.lit(0)), value, lambda a, _: a, fn)


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded half away from zero as engines do that scale it: x * 10^digits to the nearest whole
    number, over 10^digits. F.round goes by the shortest decimal that spells x, which differs where
    the product falls on a half, and has no negative zero. What overflows, NaN and infinities stay."""
    x, by = col(x), F.lit(10.0**digits)
    size = F.abs(x * by)
    near = F.rint(size)
    away = F.when(size - near == 0.5, near + 1.0).otherwise(near)
    return F.when(size < float("inf"), F.signum(x) * away / by).otherwise(x)


# --- constructors and layout


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def arange(start: float, stop: float, step: float) -> Column:
    """[start, stop) by step; a zero step is an error, a step away from stop gives an empty array."""
    if step == 0:
        raise ValueError("step must not be zero")
    n = max(0, -int(-(stop - start) // step))
    if n == 0:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * F.lit(float(step)))


def linspace(start: float, stop: float, num: int) -> Column:
    """num points with both ends; one point is start."""
    if num < 1:
        return F.array().cast("array<double>")
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: F.lit(float(start)) + i * F.lit(step))


def with_shape(data: Column | str, shape: list[int]) -> Column:
    """struct<shape, data>; a product other than the number of values raises."""
    total = 1
    for d in shape:
        total *= d
    checked = F.when(F.size(col(data)) == total, col(data)).otherwise(F.raise_error(F.lit(f"shape {shape} does not fit the data")))
    return F.struct(F.lit(shape).alias("shape"), checked.alias("data"))


def reshape(array: Column, shape: list[int]) -> Column:
    return with_shape(array["data"], shape)


def squeeze(array: Column) -> Column:
    return F.struct(F.filter(array["shape"], lambda d: d != 1).alias("shape"), array["data"].alias("data"))


def flip(x: Column | str) -> Column:
    return F.reverse(col(x))


def take(x: Column | str, start: int, end: int) -> Column:
    """Half-open slice [start, end) counted from 0."""
    return F.slice(col(x), start + 1, max(0, end - start))


def concatenate(*xs: Column | str) -> Column:
    return F.concat(*(col(x) for x in xs))


def item(x: Column | str) -> Column:
    """The one value of a one-element array; other sizes raise."""
    return F.when(F.size(col(x)) == 1, F.element_at(col(x), 1)).otherwise(F.raise_error(F.lit("not a one-element array")))


def put(x: Column | str, index: int, value: Column | float) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.transform(col(x), lambda v, i: F.when(i == index, value).otherwise(v))


# --- element-wise


def elementwise(a: Column | str, b: Column | str, op: Callable[[Column, Column], Column]) -> Column:
    """op on equal lengths; unequal ones raise (zip_with alone would pad with nulls)."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, op)).otherwise(F.raise_error(F.lit("arrays differ in length")))


def add(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: x + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: x - y)


def mul(a: Column | str, b: Column | str) -> Column:
    return elementwise(a, b, lambda x, y: x * y)


def div(a: Column | str, b: Column | str) -> Column:
    """IEEE division: x/0 is an infinity or NaN, not null."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = lambda x: F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
    return elementwise(a, b, lambda x, y: F.when(y == 0, by_zero(x)).otherwise(F.try_divide(x, y)))


def scale(x: Column | str, s: float) -> Column:
    return F.transform(col(x), lambda v: v * F.lit(s))


def shift(x: Column | str, s: float) -> Column:
    return F.transform(col(x), lambda v: v + F.lit(s))


def axpy(alpha: float, x: Column | str, y: Column | str) -> Column:
    return elementwise(x, y, lambda a, b: F.lit(alpha) * a + b)


def wrap_u8(x: Column | str) -> Column:
    """Unsigned 8-bit arithmetic wraps."""
    return F.transform(col(x), lambda v: F.pmod(v, F.lit(256)))


def each(x: Column | str, fn: Callable[[Column], Column]) -> Column:
    return F.transform(col(x), fn)


def log(x: Column | str) -> Column:
    """Natural logarithm; a value at or below zero raises instead of giving null."""
    return F.transform(col(x), lambda v: F.when(v > 0, F.log(v)).when(F.isnan(v), v).otherwise(F.raise_error(F.lit("log of a value that is not positive"))))


def sigmoid(x: Column | str) -> Column:
    return F.transform(col(x), lambda v: 1.0 / (1.0 + F.exp(-v)))


def softmax(x: Column | str) -> Column:
    """Shifted by the maximum."""
    x = col(x)
    shifted = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


# --- reductions


def total(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def mean(x: Column | str) -> Column:
    """NaN for an empty array."""
    return F.when(F.size(col(x)) == 0, F.lit(float("nan"))).otherwise(F.try_divide(total(x), F.size(col(x))))


def var(x: Column | str) -> Column:
    """Population variance; 0 for an empty array. From the sums of the values less the first one."""
    x = col(x)
    base = F.coalesce(F.get(x, F.lit(0)), F.lit(0.0))
    sums = F.aggregate(
        x,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, v: F.struct((a["s"] + (v - base)).alias("s"), (a["q"] + (v - base) * (v - base)).alias("q")),
        lambda a: F.greatest(F.lit(0.0), a["q"] / F.size(x) - F.pow(a["s"] / F.size(x), F.lit(2))),
    )
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(sums)


def std(x: Column | str) -> Column:
    return F.sqrt(var(x))


def percentile(x: Column | str, p: float) -> Column:
    """Linear interpolation on (n - 1) p / 100."""
    s, n = F.array_sort(col(x)), F.size(col(x))
    at = (n - 1) * F.lit(p / 100.0)
    lo = F.floor(at).cast("int")
    low, high = F.get(s, lo), F.get(s, F.least(lo + 1, n - 1))
    return low + (high - low) * (at - lo)


def median(x: Column | str) -> Column:
    return percentile(x, 50.0)


def dot(a: Column | str, b: Column | str) -> Column:
    """0 for empty arrays."""
    return F.aggregate(elementwise(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l1(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda s, v: s + F.abs(v))


def l2(x: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v * v))


def norm(x: Column | str, p: int) -> Column:
    if p not in (1, 2):
        raise ValueError("only L1 and L2 norms")
    return l1(x) if p == 1 else l2(x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), l2(a) * l2(b)), F.lit(0.0))


def argmin(x: Column | str) -> Column:
    """First index of the least value, from 0."""
    return F.array_position(col(x), F.array_min(col(x))) - 1


def argmax(x: Column | str) -> Column:
    return F.array_position(col(x), F.array_max(col(x))) - 1


def iamax(x: Column | str) -> Column:
    return argmax(F.transform(col(x), F.abs))


def cumsum(x: Column | str) -> Column:
    return F.aggregate(
        col(x),
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out")),
        lambda a, v: F.struct((a["s"] + v).alias("s"), F.array_append(a["out"], a["s"] + v).alias("out")),
        lambda a: a["out"],
    )


def top_k(x: Column | str, k: int) -> Column:
    """array<struct<value, index>> of the k largest, the smaller index first among equals; k over the length raises."""
    x = col(x)
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("minus"), i.alias("index")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda e: F.struct((-e["minus"]).alias("value"), e["index"].alias("index")))
    return F.when(F.size(x) >= k, best).otherwise(F.raise_error(F.lit("k exceeds the number of values")))


def log_softmax(x: Column | str) -> Column:
    x = col(x)
    lse = let(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))))
    return let(lse, lambda a: F.transform(x, lambda v: v - a))


# --- quantization


def _clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def _absmax_scale(x: Column, levels: float) -> Column:
    s = F.array_max(F.transform(x, F.abs)) / levels
    return F.when(s > 0, s).otherwise(F.lit(1.0))


def quantize_i8(x: Column | str) -> Column:
    """Symmetric: scale = absmax / 127, half away from zero, clamped; struct<q, scale>."""
    x = doubles(x)
    q = lambda s: F.transform(x, lambda v: _clamp(F.round(v / s).cast("int"), -128, 127))
    return let(_absmax_scale(x, 127.0), lambda s: F.struct(q(s).alias("q"), s.alias("scale")))


def quantize_u8(x: Column | str) -> Column:
    """Asymmetric: scale = (max - min) / 255 (1 if constant), zero point round(-min / scale) in 0..255."""
    x = doubles(x)
    low, high = F.array_min(x), F.array_max(x)
    s = F.when(high > low, (high - low) / 255.0).otherwise(F.lit(1.0))
    params = let(s, lambda k: F.struct(k.alias("scale"), _clamp(F.round(-low / k).cast("int"), 0, 255).alias("zero")))
    q = lambda p: F.transform(x, lambda v: _clamp(F.round(v / p["scale"]).cast("int") + p["zero"], 0, 255))
    return let(params, lambda p: F.struct(q(p).alias("q"), p["scale"].alias("scale"), p["zero"].alias("zero")))


def quantize_i4(x: Column | str) -> Column:
    """Symmetric 4-bit: scale = absmax / 7, values -8..7, two in a byte, the first in the low half."""
    x = doubles(x)
    q = lambda s: F.transform(x, lambda v: _clamp(F.round(v / s).cast("int"), -8, 7))
    nibble = lambda qs, i: F.coalesce(F.get(qs, i), F.lit(0)).bitwiseAND(F.lit(15))
    pairs = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int"))
    pack = lambda qs: F.transform(pairs, lambda i: nibble(qs, 2 * i).bitwiseOR(F.shiftleft(nibble(qs, 2 * i + 1), 4)))
    return let(_absmax_scale(x, 7.0), lambda s: F.struct(let(q(s), pack).alias("packed"), s.alias("scale")))


def dequantize_i4(packed: Column, scale_: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    byte = lambda p, i: F.get(p, F.floor(i / 2).cast("int"))
    half = lambda p, i: F.when(i % 2 == 0, byte(p, i)).otherwise(F.shiftright(byte(p, i), 4)).bitwiseAND(F.lit(15))
    signed = lambda v: F.when(v > 7, v - 16).otherwise(v)
    both = F.struct(packed.alias("p"), scale_.alias("s"))
    return let(both, lambda z: F.transform(F.sequence(F.lit(0), n - 1), lambda i: signed(half(z["p"], i)) * z["s"]))


# --- two-dimensional values: struct<shape, data>, row by row


def row_slice(array: Column, row: int) -> Column:
    """One row's values; a row beyond the shape raises."""
    wide = array["shape"][1]
    return F.when(array["shape"][0] > row, F.slice(array["data"], wide * row + 1, wide)).otherwise(F.raise_error(F.lit("no such row")))


def column_slice(array: Column, column: int) -> Column:
    wide = array["shape"][1]
    return F.when(wide > column, F.filter(array["data"], lambda _, i: i % wide == column)).otherwise(F.raise_error(F.lit("no such column")))


def flip_axis(array: Column, axis: int) -> Column:
    """Rows (axis 0) or the values of each row (axis 1) in the opposite order."""
    high, wide = array["shape"][0], array["shape"][1]
    at = lambda i: (high - 1 - F.floor(i / wide)) * wide + i % wide if axis == 0 else F.floor(i / wide) * wide + wide - 1 - i % wide
    return F.struct(array["shape"].alias("shape"), F.transform(array["data"], lambda _, i: F.get(array["data"], at(i).cast("int"))).alias("data"))


def concatenate_axis(a: Column, b: Column, axis: int) -> Column:
    """Two matrices one below the other (axis 0) or side by side (axis 1); other sides must be equal."""
    other = 1 - axis
    shape = F.array(*(a["shape"][d] + b["shape"][d] if d == axis else a["shape"][d] for d in (0, 1)))
    if axis == 0:
        data = F.concat(a["data"], b["data"])
    else:
        row = lambda m, i: F.slice(m["data"], m["shape"][1] * i + 1, m["shape"][1])
        data = F.flatten(F.transform(F.sequence(F.lit(0), a["shape"][0] - 1), lambda i: F.concat(row(a, i), row(b, i))))
    good = a["shape"][other] == b["shape"][other]
    return F.when(good, F.struct(shape.alias("shape"), data.alias("data"))).otherwise(F.raise_error(F.lit("shapes do not fit")))


# --- order kept beside sorted values


def sort_with_places(x: Column | str) -> Column:
    """struct<sorted, places>: values ascending and where each stood (from 0), equal ones in place order."""
    pairs = F.array_sort(F.transform(col(x), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return let(pairs, lambda p: F.struct(F.transform(p, lambda e: e["v"]).alias("sorted"), F.transform(p, lambda e: e["i"]).alias("places")))


def unsort(sorted_: Column, places: Column) -> Column:
    """The values in the places where they stood."""
    pairs = F.array_sort(F.zip_with(places, sorted_, lambda i, v: F.struct(i.alias("i"), v.alias("v"))))
    return F.transform(pairs, lambda e: e["v"])


# --- other lengths


def upsample(x: Column | str, n: int, size: int) -> Column:
    """`size` values stretched to n by linear interpolation; the last value is held."""
    x = col(x)

    def at(j: Column) -> Column:
        place = j / F.lit(n / size)
        low = F.least(F.floor(place), F.lit(size - 1)).cast("int")
        high = F.least(low + 1, F.lit(size - 1))
        part = place - F.floor(place)
        return F.get(x, low) * (1.0 - part) + F.get(x, high) * part

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def downsample(x: Column | str, n: int, size: int, low: int, high: int) -> Column:
    """`size` values as n means of successive groups, rounded half away from zero and clamped."""
    group = max(1, size // n)
    mean = lambda i: total(F.slice(col(x), i * group + 1, F.lit(group))) / F.lit(float(group))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.lit(high), F.greatest(F.lit(low), F.round(mean(i)).cast("int"))))
