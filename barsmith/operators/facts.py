"""Company facts: long reported values resolved into one row an entity and period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Concept:
    """A column of the result: the unit of its facts, its tags by falling priority, and whether it spans time (a flow)."""

    name: str
    unit: str
    tags: tuple[str, ...]
    flow: bool


def resolve_facts(facts: DataFrame, concepts: Sequence[Concept], forms: Sequence[str], annual: str, since: str | None = None) -> DataFrame:
    """entity, period_end, form, period_type, and a column for each concept, from facts (entity, tag, unit, form, start, end, filed, value).

    For a period end and form a concept takes the value of its first tag that has any. Of a tag's facts the one with
    the shortest span counts (the quarter by itself rather than the year so far; a fact without a start has none),
    of equal spans the one filed last, of those the smallest value. A row exists where a flow was reported;
    stocks fill it or are null. Facts of other forms, units and tags, and before `since`, are left out.

    One aggregation, summed up in the tasks first, serves all concepts.
    """
    rows = facts.where(F.col("form").isin(*forms) & F.col("value").isNotNull())
    if since:
        rows = rows.where(F.col("end") >= F.lit(since).cast("date"))
    rows = rows.where(F.col("tag").isin(*{t for c in concepts for t in c.tags}))
    span = F.when(F.col("start").isNull(), F.lit(0)).otherwise(F.date_diff("end", "start"))

    def best(c: Concept) -> Column:
        priority = F.array_position(F.array(*map(F.lit, c.tags)), F.col("tag"))
        fact = F.struct(priority.alias("p"), span.alias("s"), (-F.unix_date("filed")).alias("f"), F.col("value").alias("value"))
        return F.min(F.when((F.col("unit") == c.unit) & (priority > 0), fact))["value"].alias(c.name)

    out = rows.groupBy("entity", F.col("end").alias("period_end"), "form").agg(*map(best, concepts))
    flows = [c.name for c in concepts if c.flow]
    return out.where(F.coalesce(*flows).isNotNull()).withColumn("period_type", F.when(F.col("form") == annual, "annual").otherwise("quarterly"))
