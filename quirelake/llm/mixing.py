"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import cut_lineage, unit_hash, word_count

#: Buckets of the Pareto key; only the bucket in which a source's draw ends is sorted.
BUCKETS = 1 << 12
#: Rows of per-source tables up to which they are broadcast; beyond, they are joined by shuffle.
SMALL_ROWS = 50_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def source_targets(totals: DataFrame, weights: list[int], repeats: int) -> DataFrame:
    """totals (source, source_size) with a target each: all sizes shared by weight, none above repeats times its size.

    Sources by code point, null last, take the weights in turn. A source is capped if its share of
    what the capped ones leave exceeds repeats times its size; going through the sources by size per
    weight, the first that is not capped settles the share of a unit of weight for it and all after.
    One row a source goes through one window.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("place", place).withColumn("all_size", F.sum("source_size").over(every))
    order = every.orderBy(F.col("source_size") / F.col("weight"), "place")
    ranked = (
        ranked.withColumn("below", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("unit", (F.col("all_size") - repeats * F.col("below")).cast("double") / F.col("rest").cast("double"))
        .withColumn("step", F.row_number().over(order))
    )
    fits = F.col("unit") * F.col("weight") <= (repeats * F.col("source_size")).cast("double")
    first = F.min(F.when(fits, F.struct("step", "unit"))).over(every)
    capped = first.isNull() | (F.col("step") < first["step"])
    return ranked.select(
        "source", "source_size", F.when(capped, (repeats * F.col("source_size")).cast("double")).otherwise(first["unit"] * F.col("weight")).alias("target")
    )


def inclusion(classes: DataFrame, repeats: int) -> DataFrame:
    """Expected copies of each (source, level) class: in proportion to level, repeats at most, meeting the target in sizes."""
    own = Window.partitionBy("source")
    order = own.orderBy(F.col("level").desc())
    mass = F.col("level") * F.col("class_size")
    solved = (
        classes.withColumn("above", F.coalesce(F.sum("class_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("mass", F.sum(mass).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", F.when(F.col("mass") > 0, (F.col("target") - (repeats * F.col("above")).cast("double")) / F.col("mass").cast("double")))
    )
    fits = (F.col("rate") * F.col("level")) <= float(repeats)
    rate = F.max(F.when(fits, F.struct("level", "rate"))).over(own)["rate"]
    copies = F.when(F.col("rate0").isNull(), F.lit(float(repeats))).otherwise(F.least(F.lit(float(repeats)), F.col("rate0") * F.col("level")))
    return (
        solved.withColumn("rate0", rate)
        .withColumn("copies", copies)
        .withColumn("whole", F.floor("copies").cast("long"))
        .withColumn("p", F.col("copies") - F.col("whole"))
        .withColumn("draw", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(own).cast("double"))
        .select("source", "level", "source_size", "target", "whole", "p", "draw")
    )


def _measured(df: DataFrame, doc_id: str, source: str, size: Column | None, level: Column | None, seed: int, rows: bool) -> DataFrame:
    """What the draw looks at, in columns named m_*, and with rows the whole row beside them."""
    size = (word_count(F.col("text")) if size is None else size.cast("long")).alias("m_size")
    own = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if rows else []
    extra = [] if level is None else [level.cast("long").alias("m_level")]
    out = df.select(*own, F.col(f"`{doc_id}`").alias("m_id"), F.col(f"`{source}`").alias("m_source"), size, *extra)
    if level is None:
        out = out.withColumn("m_level", F.length(F.bin("m_size")).cast("long"))
    return out.withColumn("m_u", unit_hash(F.col("m_id"), seed))


@dataclass(frozen=True)
class MixPlan:
    """classes: what each (source, level) gets; cuts: where each source's draw ends and what fills its last gap. rows: of classes."""

    classes: DataFrame
    cuts: DataFrame
    rows: int

    def apply(self, measured: DataFrame) -> DataFrame:
        """measured with m_source_size, m_target and m_copies; row by row once the plan is broadcast."""
        joined = _keyed(measured, self)
        cuts = _small(self.cuts, self.rows)
        met = joined.join(cuts, joined.m_source.eqNullSafe(cuts.cut_source), "left")
        place = F.struct("m_key", "m_id", "m_size")
        inside = F.col("end").isNull() | (F.col("m_bucket") < F.col("end")) | ((F.col("m_bucket") == F.col("end")) & (place <= F.col("cut")))
        drawn = F.col("m_open") & F.coalesce(inside, F.lit(False))
        fills = F.col("m_open") & ~drawn & F.coalesce(place == F.col("fill"), F.lit(False))
        copies = F.when(F.col("m_size") > 0, F.col("whole") + drawn.cast("long") + fills.cast("long")).otherwise(0).cast("long")
        return met.withColumn("m_copies", copies).drop("m_key", "m_bucket", "m_open", "whole", "p", "draw", "cut_source", "end", "cut", "fill")


def _keyed(measured: DataFrame, plan: MixPlan) -> DataFrame:
    """measured with its class's figures, its Pareto key and the key's bucket."""
    classes = _small(plan.classes, plan.rows)
    joined = measured.join(classes, measured.m_source.eqNullSafe(classes.source) & (measured.m_level == classes.level)).drop(classes.source).drop(classes.level)
    odds = (F.col("m_u") * (1 - F.col("p"))) / ((1 - F.col("m_u")) * F.col("p"))
    joined = joined.withColumn("m_open", (F.col("p") > 0) & (F.col("m_size") > 0)).withColumn("m_key", F.when(F.col("m_open"), odds / (1 + odds)))
    return joined.withColumn("m_bucket", F.floor(F.col("m_key") * BUCKETS))


def plan_mix(measured: DataFrame, weights: tuple[int, ...], repeats: int) -> MixPlan:
    """The plan of a mix, from the m_* columns alone."""
    narrow = measured.select("m_id", "m_source", "m_size", "m_level", "m_u")
    classes = cut_lineage(narrow.groupBy(F.col("m_source").alias("source"), F.col("m_level").alias("level")).agg(F.sum("m_size").alias("class_size")))
    rows = classes.count()
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), list(weights), repeats)
    solved = classes.join(targets, classes.source.eqNullSafe(targets.source)).select(classes["*"], "source_size", "target")
    solved = cut_lineage(inclusion(solved, repeats).select("source", "level", F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"), "whole", "p", "draw"))
    open_ = _keyed(narrow, MixPlan(solved, solved, rows)).filter("m_open")

    sums = open_.groupBy("m_source", "m_bucket").agg(F.sum("m_size").alias("words"), F.first("draw").alias("draw"))
    upto = Window.partitionBy("m_source").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("words").over(upto)).filter("upto > draw").groupBy("m_source")
    ends = ends.agg(F.min(F.struct("m_bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    ends = cut_lineage(ends.select(F.col("m_source").alias("end_source"), F.col("e.m_bucket").alias("end"), F.col("e.before").alias("before")))
    small_ends = _small(ends, rows)
    place = F.struct("m_key", "m_id", "m_size")
    edge = open_.join(small_ends, open_.m_source.eqNullSafe(small_ends.end_source) & (open_.m_bucket == small_ends.end))
    ordered = Window.partitionBy("m_source").orderBy("m_key", "m_id", "m_size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.sum("m_size").over(ordered) + F.col("before")).filter("upto <= draw")
    edge = edge.groupBy(F.col("m_source").alias("cut_source")).agg(F.max(place).alias("cut"))
    cuts = cut_lineage(ends.join(edge, ends.end_source.eqNullSafe(edge.cut_source), "left").select("end_source", "end", "cut"))

    small_cuts = _small(cuts, rows)
    met = open_.join(small_cuts, open_.m_source.eqNullSafe(small_cuts.end_source), "left")
    inside = F.col("end").isNull() | (F.col("m_bucket") < F.col("end")) | ((F.col("m_bucket") == F.col("end")) & (place <= F.col("cut")))
    met = met.withColumn("drawn", F.coalesce(inside, F.lit(False)))
    gaps = met.groupBy("m_source").agg((F.first("draw") - F.sum(F.when(F.col("drawn"), F.col("m_size")).otherwise(0)).cast("double")).alias("gap"))
    gaps = _small(cut_lineage(gaps.withColumnRenamed("m_source", "gap_source")), rows)
    left = met.filter("not drawn").join(gaps, met.m_source.eqNullSafe(gaps.gap_source)).withColumn("off", F.abs(F.col("m_size") - F.col("gap")))
    fill = left.filter("off < gap").groupBy(F.col("m_source").alias("fill_source")).agg(F.min(F.struct("off", "m_key", "m_id", "m_size")).alias("f"))
    fill = fill.select("fill_source", F.struct("f.m_key", "f.m_id", "f.m_size").alias("fill"))
    cuts = cuts.join(fill, cuts.end_source.eqNullSafe(fill.fill_source), "left").select(F.col("end_source").alias("cut_source"), "end", "cut", "fill")
    return MixPlan(solved, cut_lineage(cuts), rows)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, level: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7, keep_columns: bool = False
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies and taken (copies times size).

    With keep_columns, a struct `row` of all columns of docs comes instead of doc_id and source, and rows are not shuffled.
    size defaults to the words of `text`; level, a positive integer with few values, to the digits of
    size in base 2: expected copies grow with it, as a size measure steadies what a draw of documents
    weighs. Each document gets the whole part of its expected copies for certain. The fraction p is its
    inclusion probability in a Pareto order sample: documents rank by the odds of a random number from
    the id divided by the odds of p, and the first of the order are drawn while they fit what the
    source's target leaves. The document that fits the last gap best is drawn too, if that narrows it.

    Null sources are one source, last in order; null and empty texts have size 0 and are never taken.
    Rows that share doc_id, size and source share their random number and are drawn or left together.
    An empty table gives an empty one. Other columns are not read. Sums of buckets of the order find where a draw ends,
    so a hot source is never sorted as a whole; per-source tables are broadcast up to SMALL_ROWS rows.
    """
    measured = _measured(docs, doc_id, source, size, level, seed, keep_columns)
    narrow = cut_lineage(measured.select("m_id", "m_source", "m_size", "m_level", "m_u"))
    made = plan_mix(narrow, weights, repeats).apply(measured if keep_columns else narrow)
    names = {"m_id": doc_id, "m_source": source, "m_size": "size", "m_source_size": "source_size", "m_target": "target", "m_copies": "copies"}
    if keep_columns:
        names = {"row": "row"} | {k: v for k, v in names.items() if k not in ("m_id", "m_source")}
    return made.select(*[F.col(k).alias(v) for k, v in names.items()], (F.col("m_copies") * F.col("m_size")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), n as (
  select *, length(bin(size))::bigint as level,
         ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double as u
  from d
), c as (select source, level, sum(size)::bigint as class_size from n group by all),
s0 as (select source, sum(class_size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from c group by source),
s1 as (select *, [1, 2, 3][(place % 3 + 1)::int] as weight, sum(source_size) over ()::bigint as all_size from s0),
s2 as (
  select *, row_number() over o as step,
         coalesce(sum(source_size) over (order by source_size::double / weight, place rows between unbounded preceding and 1 preceding), 0)::bigint as below,
         sum(weight) over (order by source_size::double / weight, place rows between current row and unbounded following)::bigint as rest
  from s1 window o as (order by source_size::double / weight, place)
), s3 as (select *, (all_size - 3 * below)::double / rest::double as unit from s2),
s4 as (select *, min(case when unit * weight <= (3 * source_size)::double then step end) over () as first_step from s3),
s5 as (select *, max(case when step = first_step then unit end) over () as first_unit from s4),
t as (select source, source_size, case when first_step is null or step < first_step then (3 * source_size)::double else first_unit * weight end as target from s5),
c1 as (
  select c.*, source_size, target,
         coalesce(sum(class_size) over (partition by c.source order by level desc rows between unbounded preceding and 1 preceding), 0)::bigint as above,
         sum(level * class_size) over (partition by c.source order by level desc rows between current row and unbounded following)::bigint as mass
  from c join t on c.source is not distinct from t.source
), c2 as (select *, case when mass > 0 then (target - (3 * above)::double) / mass::double end as rate from c1),
c3 as (select *, max(case when rate * level <= 3.0::double then level end) over (partition by source) as fit_level from c2),
c4 as (select *, max(case when level = fit_level then rate end) over (partition by source) as rate0 from c3),
c5 as (select *, case when rate0 is null then 3.0::double else least(3.0::double, rate0 * level) end as copies from c4),
c6 as (select *, floor(copies)::bigint as whole, copies - floor(copies)::bigint as p from c5),
c7 as (select *, target - (sum(whole * class_size) over (partition by source))::double as draw from c6),
j as (
  select n.doc_id, n.source, n.size, source_size, target, whole, p, draw, u, p > 0 and size > 0 as open
  from n join c7 on n.source is not distinct from c7.source and n.level = c7.level
), k as (select *, case when open then (u * (1 - p)) / ((1 - u) * p) end as odds from j),
k1 as (select *, odds / (1 + odds) as key from k),
w as (select *, open and sum(size) over (partition by source, open order by key, doc_id, size) <= draw as drawn from k1),
g as (select source, min(draw) - sum(case when drawn then size else 0 end)::double as gap from w group by source),
f as (
  select w.source, min({'off': abs(size - gap), 'key': key, 'doc_id': doc_id, 'size': size}) as fill
  from w join g on w.source is not distinct from g.source where open and not drawn and abs(size - gap) < gap group by w.source
)
select w.doc_id, w.size, w.source_size, w.target,
       (case when w.size > 0 then whole + drawn::int
         + coalesce(not drawn and open and key = f.fill.key and w.doc_id is not distinct from f.fill.doc_id and w.size = f.fill.size, false)::int
        else 0 end * w.size)::bigint as taken
from w left join f on w.source is not distinct from f.source
"""
