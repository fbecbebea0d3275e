"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import WORD, written

#: Points of the golden-ratio lattice: i * STEP mod PRIME, so that whole numbers stay exact for any i.
PRIME, STEP = 2147483647, 1327217885
#: Weights of the sources in order, repeating; a source gives at most so many times its size.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Slots of a schedule while blocks are shorter than WORDS words; longer mixes have blocks of WORDS words and more slots.
SLOTS, WORDS = 1 << 16, 256
#: Cells by which slots find their source with an equi-join, and slots that are numbered in one window.
CELLS, RUN = 1024, 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, idx (by code point, null last), source_size, weight, target.

    Shares of all words go by weight; a source stops at EPOCHS times its size and the excess goes to
    the others by weight. That fixed point is a water level: target = least(cap, level * weight), and
    with sources in the order of cap / weight the level is the first (total - caps before) / (weights
    from here) that does not exceed cap / weight. The windows run over one row per source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("idx") - 1) % len(WEIGHTS) + 1).cast("int"))
    one = Window.partitionBy(F.lit(0))
    by_ratio = one.orderBy("ratio", "idx")
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("idx", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("cap", EPOCHS * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(one))
        .withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "idx", "level"))).over(one)["level"])
    )
    return per.select("source", "idx", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def block_words(total: float) -> int:
    """Words of every block of a mix of so many words."""
    return max(1, min(WORDS, -int(-total // SLOTS)))


def schedule(targets: DataFrame) -> DataFrame:
    """slot, idx of its source, rank among that source's slots, block (words of every slot's block).

    Slot i has the golden-ratio point of i, which falls into one source's part of the cumulative targets. As many slots as
    blocks fill the mix; how many a source has of them is its share, up to the discrepancy of the points (two or
    three slots). Ranks are numbered in runs of RUN slots, over counts of the runs before. A source that stops at its
    cap and has missed blocks of it gets them in slots behind all others.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0] or 0
    block = block_words(total)
    n = -int(-total // block)
    run = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("idx"))
    parts = (
        targets.select("idx", "target", run.alias("high")).where("target > 0")
        .select("idx", ((F.col("high") - F.col("target")) / (total or 1)).alias("low"), (F.col("high") / (total or 1)).alias("high"))
    )
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    top = F.max("high").over(Window.partitionBy(F.lit(0)))
    parts = parts.withColumn("last", F.col("high") == top)
    slots = spark.range(n).select(F.col("id").alias("slot"), (((F.col("id") % PRIME) * STEP % PRIME + 0.5) / PRIME).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(parts, "cell").where("low <= point and (point < high or last)")
    slots = slots.select("slot", "idx", F.floor(F.col("slot") / RUN).alias("run"))
    counts = slots.groupBy("idx", "run").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("idx", "run", (F.sum("n").over(Window.partitionBy("idx").orderBy("run")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("idx", "run").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(before, ["idx", "run"]).select("slot", "idx", (F.col("before") + F.col("inside")).cast("long").alias("rank"))
    have = counts.groupBy("idx").agg(F.sum("n").alias("have"))
    full = targets.where(F.col("target") >= EPOCHS * F.col("source_size")).where("target > 0").join(have, "idx", "left").select("idx", F.coalesce("have", F.lit(0)).alias("have"), F.ceil(F.col("target") / block).alias("need"))
    missed = full.where("have < need").select("idx", F.explode(F.sequence(F.col("have").cast("long"), F.col("need").cast("long") - 1)).alias("rank"))
    behind = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "idx")) - 1 + n  # a few a source
    return ranked.unionByName(missed.select(behind.cast("long").alias("slot"), "idx", "rank")).withColumn("block", F.lit(block).cast("long"))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document and epoch: doc_id, source, key, copy, size, source_size, target, epoch, words, slot.

    Each source's documents stand in a shuffled order (by MD5 of id, source and text), repeated EPOCHS times, as one
    stream of words that is cut into equal blocks. The source's slot of rank r takes block r, so the source gives as
    many words as its slots hold and no document more than EPOCHS times its own. words is what an epoch of a document
    has in taken blocks, slot the slot of the first of these (null if there is none).

    The place of a document in its stream is a prefix sum in two steps: over buckets of about 4,096 documents of a source
    (bucket totals first), then inside each bucket; so no task holds a source. Equal rows are counted first and
    dealt out as copies afterwards, so neither null ids nor copies gather in one bucket.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")), F.lit(":"), F.col("digest")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"))
    sized = written(rows.groupBy("doc_id", "source", "size", key.alias("key")).agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    digits = max(1, min(8, -(-max(0, sized.count().bit_length() - 12) // 4)))
    targets = written(source_targets(sized.select("source", (F.col("size") * F.col("copies")).alias("size"))), "mix-targets")
    slots = written(schedule(targets), "mix-slots")
    held = slots.groupBy("idx").agg((F.count(F.lit(1)) * F.max("block")).alias("held"), F.max("block").alias("block"))
    per = targets.join(held, "idx", "left").select(F.col("source").alias("src"), "idx", "source_size", "target", F.least(EPOCHS * F.col("source_size"), F.coalesce("held", F.lit(0))).alias("end"), F.coalesce("block", F.lit(1)).alias("block"))

    placed = sized.withColumn("bucket", F.substring("key", 1, digits)).join(per, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("words", F.col("size") * F.col("copies"))
    by_bucket = Window.partitionBy("idx").orderBy("bucket")
    offsets = placed.groupBy("idx", "bucket").agg(F.sum("words").alias("all")).select("idx", "bucket", (F.sum("all").over(by_bucket) - F.col("all")).alias("offset"))
    inside = F.sum("words").over(Window.partitionBy("idx", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = placed.withColumn("inside", inside).join(offsets, ["idx", "bucket"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("offset") + F.col("inside") + F.col("copy") * F.col("size"))
    each = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
    each = each.withColumn("taken", F.greatest(F.least(F.col("from") + F.col("size"), "end") - F.col("from"), F.lit(0)))
    each = each.withColumn("rank", F.when(F.col("taken") > 0, F.floor(F.col("from") / F.col("block"))))
    ranked = slots.select("idx", "rank", "slot")
    return each.join(ranked, ["idx", "rank"], "left").select("doc_id", "source", "key", "copy", "size", "source_size", "target", "epoch", F.col("taken").cast("long").alias("words"), "slot")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, slot: the words of placements() of all epochs,
    and the first slot (null for none). The mix in order of slots draws on every source in proportion from beginning to end.

    Null text: size 0, taken 0. Null source: a source of its own, the last. Null id: as the empty string in the shuffled
    order. Repeated rows each take their own place. An empty table gives no rows. Other columns of the input are not read.
    """
    each = placements(docs, id_col, text_col, source_col)
    return each.groupBy("doc_id", "source", "key", "copy", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot")).drop("key", "copy")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of documents, dealt out and sorted by slot: so files, and rows in them, draw on all
    sources in proportion. An epoch of a document that is taken in full comes with its text, one that is taken in part with
    its first words joined by one space. Null and empty texts are not taken; null ids and repeated rows take their
    shares like others; of rows of one id, source and text, the lang and n_chars of one stand for all. Other
    columns are not read; an empty table gives no rows."""
    taken = placements(docs.select("doc_id", "text", "source")).where("words > 0").select("key", F.col("words").alias("taken"), "size", "slot")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")), F.lit(":"), digest).cast("binary"))
    texts = docs.select("doc_id", "text", "lang", "source", key.alias("key")).dropDuplicates(["key"])
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    joined = texts.join(taken, "key").withColumn("text", F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(head))
    ordered = joined.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key")
    return ordered.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op8(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: edge cases as for mix_sources()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "slot")


OP8_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce('1' || source, '0') || ':' || md5(coalesce(text, ''))) as key
  from documents),
per as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) as idx from sized group by source),
weighed as (
  select *, case (idx - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from per),
ratios as (
  select *, {EPOCHS} * source_size as cap, {EPOCHS} * source_size / cast(weight as double) as ratio, sum(source_size) over () as total from weighed),
levels as (
  select *, (total - (sum(cap) over w - cap)) / (sum(weight) over (order by ratio, idx rows between current row and unbounded following)) as level
  from ratios window w as (order by ratio, idx rows between unbounded preceding and current row)),
targets as (
  select source, idx, cast(source_size as bigint) as source_size,
         least(cast(cap as double), weight * (select level from levels where level <= ratio order by ratio, idx limit 1)) as target from levels),
mix as (
  select sum(target) as words, greatest(1, least({WORDS}, cast(ceil(sum(target) / {SLOTS}) as bigint))) as block from targets),
parts as (
  select idx, (high - target) / words as low, high / words as high, high = max(high) over () as final
  from (select *, sum(target) over (order by idx) as high from targets) t, mix where target > 0),
points as (
  select i as slot, ((i % {PRIME}) * {STEP} % {PRIME} + 0.5) / {PRIME} as point from (select unnest(range(cast(ceil(words / block) as bigint))) as i from mix)),
dealt as (
  select slot, idx, row_number() over (partition by idx order by slot) - 1 as rank from points join parts on low <= point and (point < high or final)),
missed as (
  select idx, unnest(range(have, need)) as rank
  from (select t.idx, (select count(*) from dealt d where d.idx = t.idx) as have, cast(ceil(target / block) as bigint) as need from targets t, mix where target > 0 and target >= {EPOCHS} * source_size)),
slots as (
  select slot, idx, rank from dealt
  union all select (select count(*) from points) + row_number() over (order by rank, idx) - 1, idx, rank from missed),
held as (
  select t.*, block, least({EPOCHS} * source_size, (select count(*) from slots s where s.idx = t.idx) * block) as stop from targets t, mix),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, t.idx, t.block, t.stop,
         sum(s.size) over (partition by t.idx order by s.key, s.doc_id rows between unbounded preceding and current row) - s.size as start,
         row_number() over () as n
  from sized s join held t on s.source is not distinct from t.source),
epochs as (
  select *, e * source_size + start as begins, greatest(0, least(e * source_size + start + size, stop) - (e * source_size + start)) as words from placed, unnest(range({EPOCHS})) as r(e))
select e.doc_id, cast(e.size as bigint) as size, e.source_size, e.target, cast(sum(words) as bigint) as taken, cast(min(s.slot) as bigint) as slot
from epochs e left join slots s on words > 0 and s.idx = e.idx and s.rank = begins // block
group by e.doc_id, e.size, e.source_size, e.target, e.n
"""
