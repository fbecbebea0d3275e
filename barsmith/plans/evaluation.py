"""Exact calibration (T19), separation (T37), parity of views (T35) and tree scores (T42), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import evaluation as ev
from barsmith.operators.series import exact_quantiles
from barsmith.operators.writes import reread
from barsmith.plans.base import LINE, over, query, with_views
from barsmith.plans.features import rounded, rounded_sql
from barsmith.plans.statistics import PANEL_SQL, scored
from barsmith.sources import tables as t

ISOTONIC = f"""{PANEL_SQL}, q as (select round(score, 3) as s, up, date < date '1998-01-01' as early from p),
x as (select s, row_number() over (order by s) as i, sum(sum(up)) over (order by s) as y, sum(count(*)) over (order by s) as n from q where early group by s),
spans as (select a.i as lo, b.i as hi, (b.y - coalesce(c.y, 0)) * 1.0 / (b.n - coalesce(c.n, 0)) as m from x a join x b on b.i >= a.i left join x c on c.i = a.i - 1),
low as (select lo, hi, min(m) over (partition by lo order by hi desc) as m from spans),
fitted as (select x.s, f.v from x join (select hi as i, max(m) as v from low group by hi) f using (i)),
asked as (select distinct s from q),
near as (select a.s, b.s as s0, b.v as v0, c.s as s1, c.v as v1 from asked a asof left join fitted b on a.s >= b.s asof left join fitted c on a.s <= c.s)"""


@query("t19_isotonic_exact", with_views("scores", more=ISOTONIC, sql=f"select {rounded_sql('s')} as score, {rounded_sql('case when s0 is null then v1 when s1 is null then v0 when s1 = s0 then v0 else v0 + (v1 - v0) * (s - s0) / (s1 - s0) end')} as calibrated from near"))
def t19(spark, sf_dir):
    p = scored(spark, sf_dir).select(F.round("score", 3).alias("score"), "up", "date")
    model = reread(ev.isotonic_fit(p.where("date < '1998-01-01'"), "score", "up"), "isotonic")
    d = ev.isotonic_transform(p.select("score").distinct(), "score", model)
    return d.select(rounded(F.col("score")).alias("score"), rounded(F.col("calibrated")).alias("calibrated"))


FEATURES = ("score", "close", "ratio", "volume")
GROUPS = f"""s as (select *, ntile(4) over (partition by date order by fwd, ticker) as quarter from (select p.ticker, p.date, p.score, p.fwd, b.close, b.close / b.open as ratio, cast(b.volume as double) as volume from p join bars b using (ticker, date))),
long as (select feature, x, quarter = 4 as pos from (unpivot (select score, close, ratio, volume, quarter from s where quarter in (1, 4)) on score, close, ratio, volume into name feature value x)),
steps as (select feature, x, sum(a) over w / sum(a) over v as fa, sum(b) over w / sum(b) over v as fb, sum(a) over v as na, sum(b) over v as nb, a, b, lead(x) over w as nx
  from (select feature, x, count(*) filter (pos) * 1.0 as a, count(*) filter (not pos) * 1.0 as b from long group by 1, 2) window w as (partition by feature order by x), v as (partition by feature))"""


@query("t37_feature_separation", with_views("scores", more=f"{PANEL_SQL}, {GROUPS}", sql=f"""select feature, cast(max(na) as bigint) as n_pos, cast(max(nb) as bigint) as n_neg, {rounded_sql('sum(x * a) / max(na)')} as mean_pos, {rounded_sql('sum(x * b) / max(nb)')} as mean_neg,
{rounded_sql('max(abs(fa - fb))')} as ks, {rounded_sql('sum(abs(fa - fb) * coalesce(nx - x, 0))')} as wasserstein from steps group by feature"""))
def t37(spark, sf_dir):
    from pyspark.sql import Window

    p = scored(spark, sf_dir).select("ticker", "date", "score", "fwd").join(t.bars(spark, sf_dir), ["ticker", "date"])
    p = p.select("score", "close", (F.col("close") / F.col("open")).alias("ratio"), "volume", F.ntile(4).over(Window.partitionBy("date").orderBy("fwd", "ticker")).alias("quarter"))
    d = ev.separation(p, FEATURES, F.when(F.col("quarter") == 4, True).when(F.col("quarter") == 1, False))
    return d.select("feature", "n_pos", "n_neg", *[rounded(F.col(c)).alias(c) for c in ("mean_pos", "mean_neg", "ks", "wasserstein")])


#: Two views of the bars by month: one of bars as they are, one recomputed with losses, repeats, nulls and drift.
VIEWS = """a as (select ticker, cast(date_trunc('month', date) as date) as month, close, volume, case when close > open then 'up' else 'down' end as way, open as only_here from bars),
b as (select ticker, cast(date_trunc('month', date) as date) as month, case when day(date) = 7 then null when day(date) = 9 then close * 1.001 else close * (1 + 1e-13) end as close, volume,
  case when day(date) = 11 then 'flat' when close > open then 'up' else 'down' end as way from bars where day(date) <> 3 union all select ticker, cast(date_trunc('month', date) as date), close, volume, 'up' from bars where day(date) = 5),
na as (select *, row_number() over (partition by ticker, month order by close nulls first, volume, way) as nth from a), nb as (select *, row_number() over (partition by ticker, month order by close nulls first, volume, way) as nth from b),
m as (select x.ticker is not null as l, y.ticker is not null as r, x.close as ca, y.close as cb, x.volume as va, y.volume as vb, x.way as wa, y.way as wb from na x full join nb y on x.ticker = y.ticker and x.month = y.month and x.nth = y.nth)"""
NUMBER = "select '{c}' as column_name, 'number' as kind, count(*) filter (l and r) as compared, count(*) filter (l and r and (({a} is null and {b} is null) or abs({a} - {b}) <= 1e-9 * greatest(abs({a}), abs({b}), 1))) as equal, count(*) filter (l and r and ({a} is null) <> ({b} is null)) as null_mismatch, count(*) filter (l and r and abs({a} - {b}) > 1e-9 * greatest(abs({a}), abs({b}), 1)) as value_mismatch, {d} as max_diff from m"


@query("t35_view_parity", with_views("bars", more=VIEWS, sql=" union all ".join([
    NUMBER.format(c="close", a="ca", b="cb", d=rounded_sql("max(abs(ca - cb)) filter (l and r)")), NUMBER.format(c="volume", a="va", b="vb", d=rounded_sql("max(abs(va - vb)) filter (l and r)")),
    "select 'way', 'text', count(*) filter (l and r), count(*) filter (l and r and wa = wb), 0, count(*) filter (l and r and wa <> wb), null from m",
    "select 'only_left', 'row', 0, 0, 0, count(*) filter (not r), null from m", "select 'only_right', 'row', 0, 0, 0, count(*) filter (not l), null from m", "select 'only_here', 'missing', 0, 0, 0, 0, null"])))
def t35(spark, sf_dir):
    bars = t.bars(spark, sf_dir).withColumns({"month": F.trunc("date", "month"), "day": F.dayofmonth("date"), "way": F.when(F.col("close") > F.col("open"), "up").otherwise("down")})
    left = bars.select("ticker", "month", "close", "volume", "way", F.col("open").alias("only_here"))
    close = F.when(F.col("day") == 7, None).when(F.col("day") == 9, F.col("close") * 1.001).otherwise(F.col("close") * (1 + 1e-13))
    right = bars.where("day <> 3").select("ticker", "month", close.alias("close"), "volume", F.when(F.col("day") == 11, "flat").otherwise(F.col("way")).alias("way"))
    right = right.unionByName(bars.where("day = 5").select("ticker", "month", "close", "volume", F.lit("up").alias("way")))
    return ev.parity(left, right, ["ticker", "month"]).withColumn("max_diff", rounded(F.col("max_diff")))


#: A small ensemble as a model file has it, grown from the panel's own quantiles: a root and two splits a tree.
TREES = f"""v as (select ticker, date, close / lag(close, 5) {LINE} - 1 as r5, close / avg(close) {over(20)} - 1 as r20 from bars),
cuts as (select quantile_cont(r5, [0.25, 0.5, 0.75]) as c5, quantile_cont(r20, [0.25, 0.5, 0.75]) as c20 from v)"""
BRANCH = " + ".join(f"case when r5 < c5[{k}] then case when r20 < c20[{k}] then {0.1 * k - 0.25} else {0.05 * k} end else case when r20 < c20[{k}] then {-0.05 * k} else {0.2 * k} end end" for k in (1, 2, 3))


@query("t42_tree_scores", with_views("bars", more=TREES, sql=f"select ticker, date, {rounded_sql(BRANCH.replace('r5 <', 'r5 is not null and r5 <'))} as score from v, cuts"))
def t42(spark, sf_dir):
    from barsmith.functions.columns import panel

    bars = t.bars(spark, sf_dir)
    v = bars.select("ticker", "date", (F.col("close") / F.lag("close", 5).over(panel()) - 1).alias("R5"), (F.col("close") / F.avg("close").over(panel().rowsBetween(-19, 0)) - 1).alias("r20"))
    cuts = exact_quantiles(v, ["R5", "r20"], [0.25, 0.5, 0.75]).select(F.col("R5").alias("c5"), F.col("r20").alias("c20"))
    node = lambda k, n, f, cut, left, right, value: F.struct(*[F.lit(x).cast(kind).alias(name) if not hasattr(x, "_jc") else x.cast(kind).alias(name) for x, kind, name in ((k, "int", "tree"), (n, "int", "node"), (f, "string", "feature"), (cut, "double", "threshold"), (left, "int", "left"), (right, "int", "right"), (value, "double", "value"))])
    rows = []
    for k in (1, 2, 3):
        c5, c20 = F.element_at("c5", k), F.element_at("c20", k)
        rows += [node(k, 0, "r5", c5, 1, 2, None), node(k, 1, "R20", c20, 3, 4, None), node(k, 2, "R20", c20, 5, 6, None), *[node(k, n, None, None, None, None, x) for n, x in ((3, 0.1 * k - 0.25), (4, 0.05 * k), (5, -0.05 * k), (6, 0.2 * k))]]
    trees = reread(cuts.select(F.explode(F.array(*rows)).alias("x")).select("x.*"), "trees")
    return ev.tree_scores(v, trees, ("R5", "r20")).select("ticker", "date", rounded(F.col("score")).alias("score"))
