"""Operator 10, mixing sources to target weights by Pareto order sampling [native].

Sources, in code-point order and null last, weigh 5, 2, 1 in turn and share
``SHARE`` of all words; a source's target is at most ``CAP`` times its words,
and the excess goes to the others by weight (water filling in closed form).
Within a source, expected copies grow with a document's weight, by default the
binary digits of its size, so that a long document is taken more often than a
short one: e = min(``CAP``, c * weight), with c such that the expected words
are the target.  The whole part of e is certain copies, the fraction p is the
inclusion probability of one more.  Pareto order sampling ranks documents by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and takes them
in that order up to the words that the certain copies leave open, so the sample
has a fixed size in words.

u comes from an MD5 of seed, doc_id and text: reruns agree.  Of rows of a source that
share u and size, as repeated rows do, the k-th goes on by k times the golden
ratio, modulo 1, so each is drawn for itself; they are numbered over ``SALTS`` places.  c is found from
words by source and weight class, the cut by three rounds of 4,096 buckets, each
a grouped sum: no source is ever sorted or gathered, however large.  What stands
in one task is a row a source for the targets, and at most 4,096 bucket sums a
source for the cut.

Null and empty texts have size 0 and are never taken.  Repeated rows are
alike, so which of them are taken does not matter.  Ties in the last of 2**36
buckets are taken together.  An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.spark_tools import documents, settle, stored

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
BITS, ROUNDS, SALTS = 12, 3, 64
GOLDEN = "0.6180339887498949e0"
#: Kinds of tied rows, some 30 bytes each, that are broadcast; more are joined by a shuffle.
MOST_TIED = 100_000

SIZE = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_DRAW = f"md5(concat('{SEED}|', coalesce(cast(doc_id as string), ''), '|', coalesce(text, '')))"

#: Source weights and targets; runs in Spark and in DuckDB alike.  ``sized`` has source and source_size.
TARGETS = f"""
, ranked as (
  select source, source_size, row_number() over (order by case when source is null then 1 else 0 end, source) - 1 as r,
         cast(sum(source_size) over () as double) * cast({SHARE} as double) as total
  from sized),
weighed as (
  select *, case r % 3 when 0 then cast({WEIGHTS[0]} as double) when 1 then cast({WEIGHTS[1]} as double) else cast({WEIGHTS[2]} as double) end as w,
         cast({CAP} as double) * cast(source_size as double) as cap from ranked),
filled as (
  select *, sum(cap) over (order by cap / w, r rows between unbounded preceding and current row) - cap as cap_before,
         sum(w) over (order by cap / w desc, r desc rows between unbounded preceding and current row) as w_after from weighed),
levels as (
  select *, case when (total - cap_before) / w_after <= cap / w then (total - cap_before) / w_after end as level from filled),
targets as (
  select source, source_size, least(cap, w * coalesce(max(level) over (), cast(1e300 as double))) as target from levels)
"""


#: Expected copies grow with this; a bounded number of classes, at most 32 for sizes below 2**32.
WEIGHT = "length(bin(size))"

#: c of each source from ``classes`` (source, target, weight, words): the heaviest class that stays below the cap decides; runs in Spark and in DuckDB alike.
SCALES = f"""
, stacked as (
  select source, weight,
         (max(target) over (partition by source) - cast({CAP} as double) * cast(coalesce(sum(words) over (partition by source order by weight desc rows between unbounded preceding and 1 preceding), 0) as double))
         / cast(nullif(sum(words * weight) over (partition by source order by weight rows between unbounded preceding and current row), 0) as double) as c
  from classes),
scales as (
  select source, coalesce(max(case when c * weight <= cast({CAP} as double) then c end), cast(1e300 as double)) as c from stacked group by source)
"""


def _drawn(docs: DataFrame) -> DataFrame:
    """docs with size, weight and u in (0, 1)."""
    u = (F.conv(F.substring(F.expr(_DRAW), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return docs.withColumn("size", F.expr(SIZE).cast("long")).withColumn("weight", F.expr(WEIGHT).cast("long")).withColumn("u", u)


def _apart(rows: DataFrame, small: DataFrame) -> DataFrame | None:
    """``rows`` with a u of its own for each row of a source that shares u and size with others; None if none do.

    ``small`` has source, u and size of the same rows.  Tied rows are dealt to
    SALTS places, written and numbered place by place, so that a row that
    stands a thousand times is not one task.
    """
    key = ["source", "u", "size"]
    tied = stored(small.where("size > 0").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if tied.isEmpty():
        return None
    named = F.broadcast(tied) if tied.count() <= MOST_TIED else tied
    named = named.withColumnsRenamed({c: f"_{c}" for c in key})
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("u") == F.col("_u")) & (F.col("size") == F.col("_size"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    dealt = stored(rows.join(named, same, "left_semi").withColumn("_salt", salt))
    place = Window.partitionBy(*key, "_salt").orderBy(F.lit(0))
    counts = dealt.groupBy(*key, "_salt").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n").withColumnsRenamed({c: f"_{c}" for c in key}).withColumnRenamed("_salt", "_of")
    numbered = dealt.withColumn("_k", F.row_number().over(place) - 1).join(starts, same & (F.col("_salt") == F.col("_of")))
    moved = F.col("u") + (F.col("_before") + F.col("_k")) * F.expr(GOLDEN)
    own = numbered.withColumn("u", moved - F.floor(moved)).select(*rows.columns)
    return rows.join(named, same, "left_anti").unionByName(own)


def _expected(rows: DataFrame) -> DataFrame:
    """Rows with c get certain copies, p and the Pareto rank v = q / (1 + q)."""
    each = F.when(F.col("size") > 0, F.least(F.lit(CAP), F.col("c") * F.col("weight"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("e", each).withColumn("certain", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("certain"))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    v = F.when(F.col("p") > 0, q / (1 + q)).otherwise(F.lit(1.0))
    return rows.withColumn("rank", F.least(F.floor(v * F.lit(float(2 ** (BITS * ROUNDS)))), F.lit(2 ** (BITS * ROUNDS) - 1)).cast("long"))


def targets(small: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows with source and size."""
    sized = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    return small.sparkSession.sql("with sized as (select * from {sized})" + TARGETS + "select * from targets", sized=sized)


def scales(small: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with c, the expected copies of a document by its weight."""
    words = small.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"))
    classes = _on_source(words, goal.select("source", "target"))
    found = small.sparkSession.sql("with classes as (select * from {classes})" + SCALES + "select * from scales", classes=classes)
    found = found.withColumnRenamed("source", "_s")
    return goal.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("c", F.coalesce("c", F.lit(0.0)))


def cuts(small: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with rest and cut: documents of a source with a rank up to cut are in the sample, if there is a rest."""
    ranked = _expected(_on_source(small, goal.select("source", "c"))).select("source", "size", "certain", "p", "rank")
    state, cut = None, None
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        mine = ranked if state is None else _on_source(ranked.where("p > 0"), state.select("source", "prefix")).where(F.shiftright("rank", shift + BITS) == F.col("prefix"))
        words = F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).cast("double").alias("words")
        sums = stored(mine.groupBy("source", F.shiftright("rank", shift).alias("bucket")).agg(words, F.sum(F.col("certain") * F.col("size")).alias("sure")))
        if state is None:
            sure = sums.groupBy("source").agg(F.sum("sure").alias("sure")).withColumnRenamed("source", "_s")
            state = goal.join(sure, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rest", F.col("target") - F.col("sure")).drop("_s", "sure").withColumn("before", F.lit(0.0)).withColumn("prefix", F.lit(0).cast("long"))
        runs = _on_source(sums, state.select("source", "rest", "before"))
        runs = runs.withColumn("upto", F.expr("before + sum(words) over (partition by source order by bucket)"))
        if k < ROUNDS - 1:
            # the bucket in which the words run out; the last one if they never do
            inside = runs.groupBy("source").agg(F.expr("coalesce(min(bucket) filter (where upto > rest), max(bucket))").alias("next"), F.expr("coalesce(min_by(upto - words, bucket) filter (where upto > rest), max_by(upto - words, bucket))").alias("ahead"))
        else:
            # -1: no bucket of the last prefix is taken, and the cut lies just before it
            inside = runs.groupBy("source").agg(F.expr("coalesce(max(bucket) filter (where upto - words / 2 <= rest), -1)").alias("next"), F.lit(0.0).alias("ahead"))
        inside = inside.withColumnRenamed("source", "_s")
        joined = state.join(inside, F.col("source").eqNullSafe(F.col("_s")), "left")
        last = F.coalesce("next", F.lit(-1))
        if k == ROUNDS - 1:
            last = F.when(last < 0, F.col("prefix") * 2**BITS - 1).otherwise(last)
        state = stored(joined.select(*goal.columns, "rest", last.alias("prefix"), F.coalesce("ahead", F.lit(0.0)).alias("before")), free=(sums,) if cut is None else (sums, cut))
        cut = state
    settle(state.sparkSession)
    return state.drop("before").withColumnRenamed("prefix", "cut")


def _on_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join to a table with one row per source; small ones are broadcast by Spark's own threshold."""
    table = table.withColumnRenamed("source", "_source")
    return rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _sample(small: DataFrame) -> DataFrame:
    """(source, source_size, target, c, rest, cut) of the mix of small(source, size, weight, u)."""
    return cuts(small, stored(scales(small, stored(targets(small)))))


def _taken(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Drawn rows with ``copies``, the times the mix takes each."""
    rows = _expected(_on_source(rows, table))
    chosen = (F.col("p") > 0) & (F.col("rank") <= F.col("cut")) & (F.col("rest") > 0)
    copies = F.when(F.col("size") > 0, F.col("certain") + chosen.cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("copies", copies)


def copies(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, e and ``copies``."""
    drawn = _drawn(docs)
    small = stored(drawn.select("source", "size", "weight", "u"))
    if (apart := _apart(drawn, small)) is not None:
        drawn = stored(apart)
        small = drawn.select("source", "size", "weight", "u")
    return _taken(drawn, _sample(small)).drop("u", "weight", "c", "certain", "p", "rank", "cut", "rest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small = stored(_drawn(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "weight", "u"))
    if (apart := _apart(small, small)) is not None:
        small = stored(apart)
    rows = _taken(small, _sample(small))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; the row travels whole, so no column name can clash."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")
    return copies(rows).where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")


#: The same mix in DuckDB.
ORACLE = (
    f"""
with plain as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         (cast(cast('0x' || substr(md5(concat('{SEED}|', coalesce(cast(doc_id as varchar), ''), '|', coalesce(text, ''))), 1, 13) as bigint) as double) + cast(0.5 as double)) / cast({2**52} as double) as u
  from documents),
repeats as (select *, row_number() over (partition by source, u, size) - 1 as k from plain),
draws as (select doc_id, source, size, case when k > 0 and size > 0 then u + k * cast({GOLDEN} as double) - floor(u + k * cast({GOLDEN} as double)) else u end as u from repeats),
sized as (select source, cast(sum(size) as bigint) as source_size from draws group by source)"""
    + TARGETS
    + f"""
, classes as (
  select d.source, max(t.target) as target, {WEIGHT} as weight, sum(size) as words
  from draws d join targets t on d.source is not distinct from t.source where size > 0 group by d.source, {WEIGHT})"""
    + SCALES
    + f"""
, expected as (
  select doc_id, size, d.source, t.source_size, t.target, u,
         case when size > 0 then least(cast({CAP} as double), s.c * {WEIGHT}) else cast(0 as double) end as e
  from draws d join targets t on d.source is not distinct from t.source left join scales s on d.source is not distinct from s.source),
fractions as (select *, cast(floor(e) as bigint) as certain, e - floor(e) as p from expected),
odds as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from fractions),
ranked2 as (select *, case when p > 0 then least(cast(floor(q / (1 + q) * cast({2**36} as double)) as bigint), {2**36 - 1}) else {2**36 - 1} end as rank from odds),
rests as (select source, max(target) - sum(certain * size) as rest from ranked2 group by source),
buckets as (select source, rank, cast(sum(size) as double) as words from ranked2 where p > 0 group by source, rank),
runs as (select *, sum(words) over (partition by source order by rank) as upto from buckets),
taken as (select r.source, r.rank from runs r join rests s on r.source is not distinct from s.source where upto - words / 2 <= rest and rest > 0)
select doc_id, size, source_size, target, size * (certain + case when p > 0 and t.rank is not null then 1 else 0 end) as taken
from ranked2 d left join taken t on d.source is not distinct from t.source and d.rank = t.rank
"""
)
