"""Formulaic alpha factors over the bar panel, from the rolling primitives and the cross-sectional day rank.

Every alpha needs steps that alternate between the ticker's time line and the day's cross-section. They are
grouped by depth: all columns of a stage are added before the layout changes, so the panel is exchanged by
ticker and by date once for each stage, not once for each alpha.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions.columns import day_rank, decay_linear, delay, delta, ts_argmax, ts_corr, ts_cov, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum

#: Published formulas of the factors, by number, as they are computed here.
FORMULAS = {
    "alpha001": "rank(ts_argmax(signed square of (returns < 0 ? stddev(returns, 20) : close), 5)) - 0.5",
    "alpha002": "-correlation(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    "alpha003": "-correlation(rank(open), rank(volume), 10)",
    "alpha004": "-ts_rank(rank(low), 9)",
    "alpha006": "-correlation(open, volume, 10)",
    "alpha008": "-rank(sum(open, 5) * sum(returns, 5) - delay(sum(open, 5) * sum(returns, 5), 10))",
    "alpha009": "0 < ts_min(delta(close, 1), 5) ? delta : ts_max(delta(close, 1), 5) < 0 ? delta : -delta",
    "alpha011": "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    "alpha012": "sign(delta(volume, 1)) * -delta(close, 1)",
    "alpha013": "-rank(covariance(rank(close), rank(volume), 5))",
    "alpha015": "-sum(rank(correlation(rank(high), rank(volume), 3)), 3)",
    "alpha019": "-sign(close - delay(close, 7) + delta(close, 7)) * (1 + rank(1 + sum(returns, 250)))",
    "alpha041": "sqrt(high * low) - vwap",
    "alpha046": "bands of ((delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10)",
    "alpha049": "the same slope under -0.1 ? 1 : -delta(close, 1)",
    "alpha051": "the same slope under -0.05 ? 1 : -delta(close, 1)",
    "alpha054": "-((low - close) * open^5) / ((low - high) * close^5)",
    "alpha060": "-(2 * scale(rank(money flow * volume)) - scale(rank(ts_argmax(close, 10))))",
    "alpha101": "(close - open) / (high - low + 0.001)",
}


def inputs(bars: DataFrame) -> DataFrame:
    """Bars with vwap, returns and the first differences that the factors share."""
    d = bars.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return d.withColumn("returns", F.col("close") / delay("close") - 1).withColumn("dc", delta("close")).withColumn("dv", delta("volume"))


def _signed_square(x):
    return F.signum(x) * x * x


def first_stage(bars: DataFrame) -> DataFrame:
    """Ranks over the day of what the bars have: taken first, while rows are narrow, so that what rolls over them needs
    no exchange of its own."""
    return bars.withColumns({f"r_{x}": day_rank(x) for x in ("open", "high", "low", "close", "volume")})


def line_columns(d: DataFrame) -> DataFrame:
    """Columns that need the ticker's line alone, of inputs()."""
    slope = (delay("close", 20) - delay("close", 10)) / 10 - (delay("close", 10) - F.col("close")) / 10
    d = d.withColumn("base1", _signed_square(F.when(F.col("returns") < 0, ts_std("returns", 20)).otherwise(F.col("close"))))
    d = d.withColumn("product8", ts_sum("open", 5) * ts_sum("returns", 5))
    flow = (F.col("close") - F.col("low") - (F.col("high") - F.col("close"))) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * F.col("volume")
    down = -F.col("dc")
    return d.withColumns({
        "t1": ts_argmax("base1", 5), "t2a": delta(F.log("volume"), 2), "t2b": (F.col("close") - F.col("open")) / F.col("open"), "t8": F.col("product8") - delay("product8", 10),
        "t11a": ts_max(F.col("vwap") - F.col("close"), 3), "t11b": ts_min(F.col("vwap") - F.col("close"), 3), "t11c": delta("volume", 3), "t19": 1 + ts_sum("returns", 250),
        "t60a": flow, "t60b": ts_argmax("close", 10), "gain7": F.col("close") - delay("close", 7) + delta("close", 7),
        "alpha006": -ts_corr("open", F.col("volume").cast("double"), 10),
        "alpha009": F.when(ts_min("dc", 5) > 0, F.col("dc")).when(ts_max("dc", 5) < 0, F.col("dc")).otherwise(down),
        "alpha012": F.signum("dv") * down,
        "alpha041": F.sqrt(F.col("high") * F.col("low")) - F.col("vwap"),
        "alpha046": F.when(slope > 0.25, -1.0).when(slope < 0, 1.0).otherwise(down),
        "alpha049": F.when(slope < -0.1, 1.0).otherwise(down),
        "alpha051": F.when(slope < -0.05, 1.0).otherwise(down),
        "alpha054": -(F.col("low") - F.col("close")) * F.pow("open", F.lit(5.0)) / F.nullif((F.col("low") - F.col("high")) * F.pow("close", F.lit(5.0)), F.lit(0.0)),
        "alpha101": (F.col("close") - F.col("open")) / (F.col("high") - F.col("low") + 0.001),
    })


def ticker_stage(d: DataFrame) -> DataFrame:
    """line_columns(), and rolling functions of the ranks of first_stage()."""
    return line_columns(d).withColumns({
        "alpha003": -ts_corr("r_open", "r_volume", 10), "alpha004": -ts_rank("r_low", 9), "t13": ts_cov("r_close", "r_volume", 5), "t15": ts_corr("r_high", "r_volume", 3),
    })


def scale(x: str, day: str = "date"):
    """x over the day's sum of sizes."""
    from pyspark.sql import Window

    return F.col(x) / F.nullif(F.sum(F.abs(F.col(x))).over(Window.partitionBy(day)), F.lit(0.0))


def day_stage(d: DataFrame) -> DataFrame:
    """Ranks over the day's cross-section, and scaled columns."""
    d = d.withColumns({f"r_{x}": day_rank(x) for x in ("t1", "t2a", "t2b", "t8", "t11a", "t11b", "t11c", "t13", "t15", "t19", "t60a", "t60b")})
    return d.withColumns({
        "alpha001": F.col("r_t1") - 0.5, "alpha008": -F.col("r_t8"), "alpha011": (F.col("r_t11a") + F.col("r_t11b")) * F.col("r_t11c"), "alpha013": -F.col("r_t13"),
        "alpha019": -F.signum("gain7") * (1 + F.col("r_t19")), "alpha060": -(2 * scale("r_t60a") - scale("r_t60b")),
    })


def last_stage(d: DataFrame) -> DataFrame:
    """What rolls over the ranks of day_stage()."""
    return d.withColumns({"alpha002": -ts_corr("r_t2a", "r_t2b", 6), "alpha015": -ts_sum("r_t15", 3)})


def alphas(bars: DataFrame) -> DataFrame:
    """ticker, date and the factors of FORMULAS."""
    return last_stage(day_stage(ticker_stage(inputs(first_stage(bars))))).select("ticker", "date", *FORMULAS)


def winsorised(df: DataFrame, names, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Columns with nulls as 0 and values clipped to the frame's quantiles (two passes)."""
    edges = df.agg(*[F.percentile_approx(n, [lo, hi], 10000).alias(n) for n in names])
    bounds = edges.select(*[F.col(n).alias(f"__{n}") for n in names])
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    clipped = {n: F.coalesce(F.greatest(F.least(F.col(n), F.col(f"__{n}")[1]), F.col(f"__{n}")[0]), F.lit(0.0)) for n in names}
    return joined.select(*[c for c in df.columns if c not in names], *[v.alias(n) for n, v in clipped.items()])


__all__ = ["FORMULAS", "alphas", "decay_linear", "inputs", "scale", "ts_mean", "winsorised"]
