"""Column functions: safe arithmetic, bands, rolling primitives with minimum periods, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F



def panel() -> WindowSpec:
    """A ticker's bars in time (made on call: windows need a running session)."""
    return Window.partitionBy("ticker").orderBy("date")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def back(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, this one included."""
    return (w or panel()).rowsBetween(-(n - 1), 0)


def before(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The n rows before this one."""
    return (w or panel()).rowsBetween(-n, -1)


def ahead(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The n rows after this one."""
    return (w or panel()).rowsBetween(1, n)


def safe_ratio(x, y) -> Column:
    return col(x) / F.nullif(col(y), F.lit(0))


def change(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    """x against its value n rows ago, less 1; null where that is 0."""
    return safe_ratio(col(x), F.lag(col(x), n).over(w or panel())) - 1


def abs_change_pct(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    """Change in percent of the old value's size."""
    old = F.lag(col(x), n).over(w or panel())
    return (col(x) - old) / F.nullif(F.abs(old), F.lit(0)) * 100


def zero_aware_change_pct(x, n: int = 1, w: WindowSpec | None = None) -> Column:
    """As abs_change_pct, but a change from 0 counts as 100 (to 0: 0)."""
    old = F.lag(col(x), n).over(w or panel())
    return F.when(old.isNull(), None).when((old == 0) & (col(x) == 0), 0.0).when(old == 0, 100.0).otherwise((col(x) - old) / F.nullif(F.abs(old), F.lit(0)) * 100)


def signed_log(x) -> Column:
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def no_nan(x) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(col(x)) | (F.abs(col(x)) == float("inf")), None).otherwise(col(x))


def band(x, edges: Sequence[float], values: Sequence, default=None) -> Column:
    """The value of the first right-open band [edge i, edge i+1) that holds x; beyond the last edge, default."""
    out = F.when(F.lit(False), F.lit(values[0]))
    for lo, hi, v in zip(edges, edges[1:], values, strict=False):
        out = out.when((col(x) >= lo) & (col(x) < hi), v)
    return out.otherwise(F.lit(default))


def bin_class(x, edges: Sequence[float]) -> Column:
    """Class number by edges, low exclusive and high inclusive; null counts as the first class."""
    out = F.when(col(x).isNull() | (col(x) <= edges[0]), 0)
    for k, hi in enumerate(edges[1:], 1):
        out = out.when(col(x) <= hi, k)
    return out.otherwise(len(edges))


def threshold_label(x, limits: Sequence[tuple[float, str]], default: str) -> Column:
    """The first label whose limit x reaches, from high to low."""
    out = F.when(F.lit(False), F.lit(default))
    for limit, label in limits:
        out = out.when(col(x) >= limit, label)
    return out.otherwise(default)


def encode_categories(x, vocabulary: Sequence[str]) -> Column:
    """Place in the frozen vocabulary; null for anything else."""
    table = F.create_map(*[F.lit(v) for k, w in enumerate(vocabulary) for v in (w, k)])
    return table[col(x)]


def full(value: Column, x, n: int, frame: WindowSpec) -> Column:
    """value where all n rows of the frame have x."""
    return F.when(F.count(col(x)).over(frame) == n, value)


def ts_mean(x, n: int, w=None) -> Column:
    return full(F.avg(col(x)).over(back(n, w)), x, n, back(n, w))


def ts_sum(x, n: int, w=None) -> Column:
    return full(F.sum(col(x)).over(back(n, w)), x, n, back(n, w))


def ts_std(x, n: int, w=None) -> Column:
    return full(F.stddev_samp(col(x)).over(back(n, w)), x, n, back(n, w))


def ts_min(x, n: int, w=None) -> Column:
    return full(F.min(col(x)).over(back(n, w)), x, n, back(n, w))


def ts_max(x, n: int, w=None) -> Column:
    return full(F.max(col(x)).over(back(n, w)), x, n, back(n, w))


def ts_corr(x, y, n: int, w=None) -> Column:
    """Pearson correlation; null where one side does not vary (the built-in aggregate raises there)."""
    f = back(n, w)
    spread = F.stddev_samp(col(x)).over(f) * F.stddev_samp(col(y)).over(f)
    return full(F.covar_samp(col(x), col(y)).over(f) / F.nullif(spread, F.lit(0.0)), col(x) + col(y), n, f)


def ts_cov(x, y, n: int, w=None) -> Column:
    return full(F.covar_samp(col(x), col(y)).over(back(n, w)), col(x) + col(y), n, back(n, w))


def ts_list(x, n: int, w=None) -> Column:
    return F.collect_list(col(x)).over(back(n, w))


def ts_rank(x, n: int, w=None) -> Column:
    """Average rank of the last value among the last n, as a share of n."""
    seen = ts_list(x, n, w)
    below, equal = F.size(F.filter(seen, lambda v: v < col(x))), F.size(F.filter(seen, lambda v: v == col(x)))
    return full((below + (equal + 1) / 2) / n, x, n, back(n, w))


def ts_argmax(x, n: int, w=None) -> Column:
    """Place (from 1, oldest first) of the first maximum among the last n."""
    seen = ts_list(x, n, w)
    return full(F.array_position(seen, F.array_max(seen)), x, n, back(n, w))


def ts_argmin(x, n: int, w=None) -> Column:
    seen = ts_list(x, n, w)
    return full(F.array_position(seen, F.array_min(seen)), x, n, back(n, w))


def ts_product(x, n: int, w=None) -> Column:
    return full(F.aggregate(ts_list(x, n, w), F.lit(1.0), lambda a, v: a * v), x, n, back(n, w))


def delta(x, n: int = 1, w=None) -> Column:
    return col(x) - F.lag(col(x), n).over(w or panel())


def delay(x, n: int = 1, w=None) -> Column:
    return F.lag(col(x), n).over(w or panel())


def decay_linear(x, n: int, w=None) -> Column:
    """Mean of the last n with weights 1 (oldest) to n."""
    total = sum((F.lag(col(x), n - i).over(w or panel()) if i < n else col(x)) * i for i in range(1, n + 1))
    return total / (n * (n + 1) / 2)


def day_rank(x, by: str = "date") -> Column:
    """Average-tie rank within the day as a share of the day's values; null stays null."""
    line = Window.partitionBy(by).orderBy(col(x).asc_nulls_last())  # one order for all three: one sort a ranked column
    ties = F.count(F.lit(1)).over(line.rangeBetween(Window.currentRow, Window.currentRow))
    every = F.count(col(x)).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(col(x).isNotNull(), (F.rank().over(line) + (ties - 1) / 2) / every)


def percent_rank(x, *by: str) -> Column:
    return F.percent_rank().over(Window.partitionBy(*(by or ("date",))).orderBy(col(x)))


def last_known(x, w: WindowSpec | None = None) -> Column:
    """Forward fill."""
    return F.last(col(x), ignorenulls=True).over((w or panel()).rowsBetween(Window.unboundedPreceding, 0))


def rolling_percentile(seen: str, x: str, n: int) -> Column:
    """Share of the other n - 1 values of the full list `seen` that lie below x."""
    return F.when(F.size(seen) == n, F.size(F.filter(seen, lambda v: v < F.col(x))) / (n - 1))
