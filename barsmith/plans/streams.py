"""Incremental operators (G, C) over keyed streams and single days, each held against the SQL of the whole history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barsmith.operators import quality as q
from barsmith.operators import sessions as s
from barsmith.operators.writes import reread
from barsmith.plans.base import LINE, SO_FAR, query, with_views
from barsmith.plans.features import FLAGGED, flagged
from barsmith.plans.timeline import GRACE, SESSIONS, hold
from barsmith.sources import tables as t
from barsmith.streaming import incremental as inc

CUTS, DELAY = ("1996-07-01", "1998-01-01", "1999-07-01"), "30 days"


def streamed(spark, days, make):
    inc.use_rocksdb(spark)
    return inc.replay(reread(days, "stream-days"), make, CUTS, f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}")


@query("g7_session_stream", with_views("bars", more=f"{FLAGGED},\n{SESSIONS}", sql="select ticker, cast(session_id as int) as session_id, entry_date, exit_date from sessions"))
def g7(spark, sf_dir):
    days = flagged(spark, sf_dir).select("ticker", "date", F.coalesce(hold(), F.lit(False)).alias("hold"), F.coalesce("breakout_ok", F.lit(False)).alias("signal"))
    events = streamed(spark, days, lambda stream: inc.session_events(stream, DELAY))
    return events.groupBy("ticker", "session_id").agg(F.min("entry_date").alias("entry_date"), F.max("exit_date").alias("exit_date"))


@query("g2_membership_stream", with_views("bars", more=f"""d as (select ticker, date, cast(close >= 500 as int) as ok from bars),
i as (select *, sum(ok) {SO_FAR} as island from d),
f as (select *, sum(1 - ok) over (partition by ticker, island order by date rows between unbounded preceding and current row) as streak from i),
e as (select ticker, date, ok = 1 as is_active from f where ok = 1 or (island > 0 and streak = {GRACE}))""",
    sql=f"select ticker, date as effective_date, is_active from (select *, lag(is_active) {LINE} as p from e) where (p is null and is_active) or p <> is_active"))
def g2(spark, sf_dir):
    days = t.bars(spark, sf_dir).select("ticker", "date", (F.col("close") >= 500).alias("passes"))
    return streamed(spark, days, lambda stream: inc.membership_events(stream, GRACE, DELAY))


@query("g2_membership_day", with_views("bars", sql="""select d.ticker, d.date as effective_date, d.a as is_active from (select ticker, date, close > 1400 as a from bars where date = date '1997-06-16') d
left join (select ticker, arg_max(close > 1400, date) as was from bars where date < date '1997-06-16' group by ticker) s using (ticker) where coalesce(was, false) <> d.a"""))
def g2_day(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date", (F.col("close") > 1400).alias("is_active"))
    return s.membership_delta(d.where("date < '1997-06-16'").withColumnRenamed("date", "effective_date"), d.where("date = '1997-06-16'"))


@query("c10_panel_gaps", with_views("bars", "profiles", sql="""select industry, count(*) as missing, min(date) as first_missing, max(date) as last_missing from (
  select p.industry, c.date from (select industry, min(date) as lo, max(date) as hi from bars join profiles using (ticker) group by industry) p join (select distinct date from bars) c on c.date between lo and hi)
  x where not exists (select 1 from bars b join profiles f using (ticker) where f.industry = x.industry and b.date = x.date) group by industry"""))
def c10(spark, sf_dir):
    bars = t.bars(spark, sf_dir).select("ticker", "date")
    panels = bars.join(t.profiles(spark, sf_dir).select("ticker", "industry"), "ticker").select("industry", "date")
    return q.panel_gaps(panels, "industry", bars.select("date"))
