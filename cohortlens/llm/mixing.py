"""Mixing sources to target weights by capped water-filling.

Targets follow the weights of the sources; a source whose target exceeds ``MAX_EPOCHS`` times what
it holds is clamped there, and what it leaves is shared again by weight until no target is above
its cap. A source's target is then met by whole repetitions of all its documents, and by a seeded
choice of documents for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, staged, table, text_hash
from cohortlens.session import lookup

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
# Seeded order is summed in so many parts per source, so no task sums up a whole source.
PARTS = 4096
# Equal rows are counted in so many entries at most.
SPREAD = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Size of each document, and its place in the seeded order, from id and text."""
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    lot = F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), text))
    return documents(docs, "source").select(
        "doc_id", "source", words(F.col("text")).alias("size"), lot.alias("lot"), text_hash().alias("text_hash")
    ).withColumn("part", F.conv(F.substring("lot", 1, 3), 16, 10).cast("int"))


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Target words of each source; ``sources`` has ``source`` and ``source_size``.

    Sources take the weights in turn, by code point, null last. With sources in the order of
    size per weight, the clamped ones come first: a source is clamped if its cap is below what the
    words not yet given out would give it.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.select("*", (left / weight_left).alias("level"))
    clamped = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~clamped, F.struct(F.col("cap") / F.col("weight"), "source", "level")))
    return filled.select(
        "*", clamped.alias("clamped"), level.over(everything)["level"].alias("final")
    ).select(
        "source",
        "source_size",
        F.when(F.col("clamped"), F.col("cap").cast("double"))
        .otherwise(F.col("final") * F.col("weight"))
        .alias("target"),
    )


def planned(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """How often the mix takes documents: of ``n`` equal rows all ``times`` times, ``more`` of them once more.

    Rows that are equal in source, id and text are counted before anything else, and are one entry, or up to
    ``SPREAD`` entries if there are many, so they never meet as rows.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    rows = measured(docs, seed).withColumn("salt", salt)
    equal = ("doc_id", "source", "size", "lot", "text_hash", "part", "salt")
    entries = staged(rows.groupBy(*equal).agg(F.count("*").alias("n")))
    parts = staged(entries.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words")))
    goals = targets(
        parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs
    )
    before = F.sum("words").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    plan = parts.select(
        F.col("source").alias("of"), F.col("part").alias("slice"), F.coalesce(before, F.lit(0)).alias("before")
    ).join(goals, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    times = F.coalesce(
        F.floor(F.try_divide("target", "source_size")), F.lit(0)
    ).cast("long")
    plan = staged(plan.select("*", times.alias("times"))).select(
        "*", (F.col("target") - F.col("times") * F.col("source_size")).alias("rest")
    )
    taken_before = F.coalesce(
        F.sum(F.col("size") * F.col("n")).over(
            Window.partitionBy("of", "slice")
            .orderBy("lot", "doc_id", "size", "salt")
            .rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    start = F.col("before") + F.col("sum_before")
    fits = start + F.col("size") / 2 <= F.col("rest")
    # Of equal rows those are taken of which half still fits, one after the other.
    many = F.floor(F.try_divide(F.col("rest") - start, F.col("size")) - 0.5) + 1
    more = (
        F.when(~fits | (F.col("times") >= max_epochs), F.lit(0))
        .when((F.col("n") == 1) | (F.col("size") == 0), F.col("n"))
        .otherwise(F.greatest(F.lit(1), F.least(F.col("n"), many)))
    )
    chosen = staged(
        entries.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("slice")))
        .withColumn("sum_before", taken_before)
        .select(
            "doc_id", "source", "size", "lot", "text_hash", "salt", "n", "source_size", "target", "times", "rest",
            more.cast("long").alias("more"),
        )
    )
    # What the choice misses the rest by, and the one document whose change mends that best.
    missed = chosen.groupBy("source").agg(
        (F.first("rest") - F.sum(F.col("size") * F.col("more"))).alias("missed")
    )
    missed = lookup(staged(missed.select(F.col("source").alias("of"), "missed")))
    ways = F.array(
        F.when(F.col("more") > 0, F.lit(-1)),
        F.when((F.col("more") < F.col("n")) & (F.col("times") < max_epochs), F.lit(1)),
    )
    gap = F.abs(F.col("missed") - F.col("way") * F.col("size"))
    best = (
        chosen.withColumn("way", F.explode(F.array_compact(ways)))
        .join(missed, F.col("source").eqNullSafe(F.col("of")))
        .where(gap < F.abs("missed"))
        .groupBy("of")
        .agg(F.min(F.struct(gap.alias("gap"), "lot", "doc_id", "size", "salt", "way")).alias("best"))
    )
    names = ("of", "l", "d", "s", "t", "way")
    fields = ("lot", "doc_id", "size", "salt", "way")
    best = lookup(staged(best.select("of", *(f"best.{f}" for f in fields)).toDF(*names)))
    mended = (
        F.col("source").eqNullSafe(F.col("of"))
        & (F.col("lot") == F.col("l"))
        & F.col("doc_id").eqNullSafe(F.col("d"))
        & (F.col("size") == F.col("s"))
        & (F.col("salt") == F.col("t"))
    )
    return chosen.join(best, mended, "left").select(
        "doc_id", "size", "source_size", "target", "text_hash", "lot", "salt", "n", "times",
        (F.col("more") + F.coalesce("way", F.lit(0))).alias("more"),
    )


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of each document: ``taken`` words, a whole multiple of its size.

    Every document is taken as often as the target holds its source in full. For the rest, documents
    in the order of their seeded lot are taken once more while half of the next one still fits, and
    then the one document is added or left out that brings the sum nearest to the target. Null
    sources form one source. Documents without words take part with size 0; an empty table
    gives no rows. Rows that are equal in id and text have the same lot; as many of them are taken
    once more as fit, and one alone is added or left out. Columns other than id, text and source are not
    looked at.
    """
    entries = planned(docs, weights, max_epochs, seed).repartition("lot", "salt")
    repeats = F.col("times") + (F.col("place") <= F.col("more")).cast("int")
    return entries.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * repeats).cast("long").alias("taken"),
        "text_hash",
        repeats.cast("int").alias("repeats"),
    )


def repetitions(docs: DataFrame) -> DataFrame:
    """How often the mix takes each ``doc_id`` and ``text_hash``, rows that are equal in both together."""
    taken = F.sum(F.col("n") * F.col("times") + F.col("more")).cast("int")
    return planned(docs).groupBy("doc_id", "text_hash").agg(taken.alias("repeats"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
with d as (
  select doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as lot
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from d group by source),
f as (
  select *, 3 * source_size as cap, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last
      rows between unbounded preceding and 1 preceding), 0) as given,
    sum(weight) over (order by 3 * source_size / weight, source nulls last
      rows between current row and unbounded following) as weights
  from s),
g as (select *, cast(total - given as double) / cast(weights as double) as level from f),
h as (select *, cap <= level * weight as clamped from g),
t as (
  select source, source_size,
    case when clamped then cast(cap as double) else weight
      * (select level from h where not clamped order by cap / weight, source nulls last limit 1)
    end as target
  from h),
c as (
  select d.doc_id, d.source, d.lot, d.size, t.source_size, t.target,
    coalesce(cast(floor(t.target / nullif(t.source_size, 0)) as bigint), 0) as times,
    sum(d.size) over (partition by d.source order by d.lot, d.doc_id, d.size
      rows between unbounded preceding and current row) as upto
  from d join t on d.source is not distinct from t.source),
e as (
  select *, target - times * source_size as rest,
    upto - size + size / 2 <= target - times * source_size as once_more
  from c),
m as (
  select *, rest - sum(case when once_more then size else 0 end) over (partition by source) as missed
  from e),
n as (select *, abs(missed - case when once_more then -size else size end) as gap from m),
o as (
  select *, gap < abs(missed) and 1 = row_number() over (
    partition by source order by gap < abs(missed) desc, gap, lot, doc_id, size) as mended
  from n)
select doc_id, size, source_size, target,
  cast(size * (times + case when once_more <> mended then 1 else 0 end) as bigint) as taken
from o"""
