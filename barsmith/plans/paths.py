"""Forward paths from every start day (B7, T31) and fact resolution (E1), each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.operators import cones as cn
from barsmith.operators.facts import Concept, resolve_facts
from barsmith.plans.base import LINE, query, with_views
from barsmith.plans.features import rounded, rounded_sql
from barsmith.sources import tables as t

H = 60
#: Daily mean of a sector's returns, cut at one half and damped: the mapped prices jump.
BOOKS_SQL = f"""daily as (select ticker, date, close / lag(close) {LINE} - 1 as d from bars),
moves as (select ticker, date, case when d is not null then greatest(least(d, 0.5), -0.5) / 20 end as r from daily),
books as (select sector as book, date, round(avg(r), 9) - 0.0011 as r from moves join profiles using (ticker) where r is not null group by 1, 2),
market as (select date, avg(r) - 0.0011 as b from moves where r is not null group by 1)"""


def moves(spark, sf_dir):
    daily = F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1
    return t.bars(spark, sf_dir).select("ticker", "date", (F.greatest(F.least(daily, F.lit(0.5)), F.lit(-0.5)) / 20).alias("r"), daily.alias("d")).where("d is not null").drop("d")


def books(spark, sf_dir):
    d = moves(spark, sf_dir).join(t.profiles(spark, sf_dir).select("ticker", F.col("sector").alias("book")), "ticker")
    return d.groupBy("book", "date").agg((F.round(F.avg("r"), 9) - 0.0011).alias("r"))


CELLS_SQL = f"""{BOOKS_SQL},
placed as (select *, row_number() over w as p, product(1 + r) over w as g from books window w as (partition by book order by date)),
paths as (select a.book, a.date as start_date, b.date, a.g as g0, b.g, b.p - a.p as k, b.r, max(b.g) over (partition by a.book, a.p order by b.p) as top from placed a join placed b on b.book = a.book and b.p between a.p and a.p + {H}),
cells as (select book, start_date, max(date) as end_date, avg(r) filter (k > 0) / nullif(stddev_samp(r) filter (k > 0), 0) * sqrt(252) as sharpe, arg_max(g, k) / arg_min(g, k) - 1 as total_return, max(1 - g / top) as max_drawdown
  from paths group by 1, 2 having max(k) = {H})"""
CELL = ("sharpe", "total_return", "max_drawdown", "calmar")


@query("b7_cone_cells", with_views("bars", "profiles", more=CELLS_SQL, sql=f"select book, start_date, end_date, {', '.join(f'{rounded_sql(c)} as {c}' for c in CELL[:3])}, {rounded_sql('total_return / nullif(max_drawdown, 0)')} as calmar from cells"))
def b7(spark, sf_dir):
    return cn.cone_cells(books(spark, sf_dir), H).select("book", "start_date", "end_date", *[rounded(F.col(c)).alias(c) for c in CELL])


RULES = {"median_sharpe": (">", 0.20), "pct_negative": ("<", 42.0), "median_calmar": (">", 0.10), "alpha": (">", 0.0)}
SUMMARY = ("median_sharpe", "p25_sharpe", "p75_sharpe", "floor_sharpe", "pct_negative", "median_calmar", "median_max_drawdown", "worst_max_drawdown")
CONE_SQL = f"""{CELLS_SQL},
cone as (select count(*) as n_cells, quantile_cont(sharpe, 0.5) as median_sharpe, quantile_cont(sharpe, 0.25) as p25_sharpe, quantile_cont(sharpe, 0.75) as p75_sharpe, min(sharpe) as floor_sharpe, avg(cast(sharpe < 0 as int)) * 100 as pct_negative,
  quantile_cont(total_return / nullif(max_drawdown, 0), 0.5) as median_calmar, quantile_cont(max_drawdown, 0.5) as median_max_drawdown, max(max_drawdown) as worst_max_drawdown from cells where sharpe is not null),
pooled as (select p.date, avg(p.r) as r from cells c join placed p on p.book = c.book and p.date > c.start_date and p.date <= c.end_date group by 1),
fit as (select covar_pop(r, b) / nullif(var_pop(b), 0) as beta, (avg(r) - covar_pop(r, b) / nullif(var_pop(b), 0) * avg(b)) * 252 as alpha, count(*) as days from pooled join market using (date))"""


def cone(spark, sf_dir):
    d = books(spark, sf_dir)
    market = moves(spark, sf_dir).groupBy("date").agg((F.avg("r") - 0.0011).alias("b"))
    return cn.cone_summary(cn.cone_cells(d, H)).crossJoin(cn.alpha_beta(cn.pooled_returns(d, H), market))  # one row each


@query("t31_cone_summary", with_views("bars", "profiles", more=CONE_SQL, sql=f"select n_cells, {', '.join(f'{rounded_sql(c)} as {c}' for c in SUMMARY)}, {rounded_sql('alpha')} as alpha, {rounded_sql('beta')} as beta, days from cone, fit"))
def t31(spark, sf_dir):
    return cone(spark, sf_dir).select("n_cells", *[rounded(F.col(c)).alias(c) for c in (*SUMMARY, "alpha", "beta")], "days")


@query("t31_cone_gates", with_views("bars", "profiles", more=CONE_SQL, sql=" union all ".join(f"select '{c}' as gate, {rounded_sql(c)} as value, cast({x} as double) as threshold, coalesce({c} {op} {x}, false) as passes from cone, fit" for c, (op, x) in RULES.items())))
def t31_gates(spark, sf_dir):
    return cn.gates(cone(spark, sf_dir), RULES).withColumn("value", rounded(F.col("value")))


CONCEPTS = (
    Concept("revenue", "USD", ("RevenueFromContracts", "SalesRevenueNet", "Revenues"), True), Concept("net_income", "USD", ("NetIncomeLoss", "ProfitLoss"), True),
    Concept("assets", "USD", ("Assets",), False), Concept("shares", "shares", ("SharesOutstanding", "CommonStockShares"), False))
TAGS = ("RevenueFromContracts", "SalesRevenueNet", "Revenues", "NetIncomeLoss", "ProfitLoss", "Assets", "SharesOutstanding", "CommonStockShares", "Unrelated")
STOCKS = ("Assets", "SharesOutstanding", "CommonStockShares")
SINCE = "1996-01-01"
#: Line items as facts: tag, form and span by their keys, ends at quarters, late and repeated filings.
FACTS_SQL = f"""facts as (select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as entity, tag, case when tag in ('SharesOutstanding', 'CommonStockShares') and l_linenumber <> 7 then 'shares' else 'USD' end as unit,
  case when l_orderkey % 11 = 0 then '8-K' when month("end") = 12 and l_orderkey % 2 = 0 then '10-K' else '10-Q' end as form,
  case when tag in {STOCKS} then null when l_linenumber % 3 = 0 then cast(date_trunc('year', "end") as date) when l_linenumber % 3 = 1 then cast(date_trunc('quarter', "end") as date) else cast(date_trunc('month', "end") as date) end as start,
  "end", cast("end" + cast(20 + l_orderkey % 40 as int) as date) as filed, l_extendedprice as value
  from (select *, cast(last_day(date_trunc('quarter', l_shipdate) + interval 2 month) as date) as "end", {list(TAGS)}[cast(l_partkey % {len(TAGS)} as int) + 1] as tag from lineitem)),
spans as (select *, case when start is null then 0 else date_diff('day', start, "end") end as span from facts where form in ('10-K', '10-Q') and "end" >= date '{SINCE}'),
best as (select entity, "end", form, tag, unit, value from spans qualify row_number() over (partition by entity, "end", form, tag, unit order by span, filed desc, value) = 1)"""
COLUMN = "(select value from best b where b.entity = k.entity and b.\"end\" = k.\"end\" and b.form = k.form and b.unit = '{unit}' and b.tag in {tags} order by list_position({names}, b.tag) limit 1) as {name}"


def _picked(c):
    names = list(c.tags)
    return COLUMN.format(unit=c.unit, tags="(" + ", ".join(f"'{x}'" for x in names) + ")", names=names, name=c.name)


@query("e1_resolved_facts", with_views(more=FACTS_SQL, sql=f"""select entity, "end" as period_end, form, case when form = '10-K' then 'annual' else 'quarterly' end as period_type, revenue, net_income, assets, shares from (
select k.*, {', '.join(map(_picked, CONCEPTS))} from (select distinct entity, "end", form from best) k) where revenue is not null or net_income is not null"""))
def e1(spark, sf_dir):
    rows = t.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("l_partkey") % len(TAGS) + 1).cast("int"))
    d = rows.withColumns({"end": end, "tag": tag})
    start = F.when(F.col("tag").isin(*STOCKS), None).when(F.col("l_linenumber") % 3 == 0, F.trunc("end", "year")).when(F.col("l_linenumber") % 3 == 1, F.trunc("end", "quarter")).otherwise(F.trunc("end", "month"))
    facts = d.select(
        t.ticker().alias("entity"), "tag", F.when(F.col("tag").isin(*STOCKS[1:]) & (F.col("l_linenumber") != 7), "shares").otherwise("USD").alias("unit"),
        F.when(F.col("l_orderkey") % 11 == 0, "8-K").when((F.month("end") == 12) & (F.col("l_orderkey") % 2 == 0), "10-K").otherwise("10-Q").alias("form"),
        start.alias("start"), "end", F.date_add("end", (20 + F.col("l_orderkey") % 40).cast("int")).alias("filed"), F.col("l_extendedprice").alias("value"))
    return resolve_facts(facts, CONCEPTS, ("10-K", "10-Q"), "10-K", SINCE).select("entity", "period_end", "form", "period_type", "revenue", "net_income", "assets", "shares")
