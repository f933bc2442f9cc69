"""Calibration, tag profiles, agreement and paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ordinals import numbered_by


def item_difficulty(rows: DataFrame) -> DataFrame:
    rate = F.avg((F.col("score") == 1).cast("double"))
    out = rows.where("score is not null").groupBy("item_id").agg(F.round(rate, 6).alias("difficulty"), F.count("*").alias("n"))
    return out.withColumn("saturated", F.col("difficulty").isin(0.0, 1.0))


def item_discrimination(rows: DataFrame) -> DataFrame:
    """Correctness among the better half of models minus that among the worse half."""
    scored = rows.where("score is not null")
    models = scored.groupBy("model").agg(F.avg("score").alias("m")).withColumn("half", F.ntile(2).over(Window.orderBy(F.desc("m"), "model")))
    halves = scored.join(models.select("model", "half"), "model").groupBy("item_id")
    rate = lambda h: F.avg(F.when(F.col("half") == h, (F.col("score") == 1).cast("double")))
    return halves.agg(F.round(rate(1) - rate(2), 6).alias("discrimination"))


def acceptance_band(report: DataFrame, low: float = 5.0, high: float = 95.0, strict: bool = False) -> DataFrame:
    s = F.col("suite_score")
    inside = (s > low) & (s < high) if strict else s.between(low, high)
    return report.select("model", "suite_score", inside.alias("in_band"))


def kill_criterion(report: DataFrame, reference: str, margin: float = 10.0) -> DataFrame:
    """Whether the best other model leads the reference by more than the margin."""
    out = report.agg(F.max(F.when(F.col("model") != reference, F.col("suite_score"))).alias("best"), F.max(F.when(F.col("model") == reference, F.col("suite_score"))).alias("reference"))
    return out.withColumn("lead", F.round(F.col("best") - F.col("reference"), 6)).withColumn("halt", F.col("lead") > margin)


def histogram(items: DataFrame, buckets: int = 4) -> DataFrame:
    at = F.least(F.floor(F.col("difficulty_prior") * buckets), F.lit(buckets - 1)).cast("int")
    return items.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


def suite_coverage(tagged: DataFrame) -> DataFrame:
    """Least items per tag, most per source and all items of tagged(item_id, tag, source)."""
    items = F.count_distinct("item_id")
    tags = tagged.groupBy("tag").agg(items.alias("n")).agg(F.min("n").alias("min_per_tag"))
    origins = tagged.groupBy("source").agg(items.alias("n")).agg(F.max("n").alias("max_per_source"), F.sum("n").alias("n_items"))
    return tags.crossJoin(origins)  # one row each


def tag_profile(rows: DataFrame, least: int = 8) -> DataFrame:
    """Accuracy of (model, tag) less the roster's mean, for tags of enough items, ranked within models."""
    acc = rows.groupBy("tag", "model").agg(F.avg("score").alias("a"))
    wide = rows.groupBy("tag").agg(F.count_distinct("item_id").alias("n_items")).where(F.col("n_items") >= least)
    roster = acc.join(wide, "tag").withColumn("delta", F.round(F.col("a") - F.avg("a").over(Window.partitionBy("tag")), 6))
    rank = F.rank().over(Window.partitionBy("model").orderBy(F.desc("delta"), "tag"))
    return roster.select("tag", "model", "n_items", F.round("a", 6).alias("accuracy"), "delta", rank.alias("rank"))


def tag_gap(rows: DataFrame) -> DataFrame:
    acc = rows.groupBy("tag", "model").agg(F.avg("score").alias("a"))
    return acc.groupBy("tag").agg(F.round(F.max("a") - F.min("a"), 6).alias("gap"))


def agreement(pairs: DataFrame, bound: float = 0.20) -> DataFrame:
    """Disagreement of pairs(a, b) without DEFER; kill iff strictly above the bound."""
    judged = pairs.where("a <> 'DEFER' and b <> 'DEFER'")
    out = judged.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_disagree"))
    rate = F.col("n_disagree") / F.nullif(F.col("n"), F.lit(0))
    return out.withColumn("disagreement", F.round(rate, 6)).withColumn("kill", F.coalesce(rate > bound, F.lit(False)))


def macro_score(rows: DataFrame) -> DataFrame:
    """Equal-task score of rows(arm, task_id, passed)."""
    tasks = rows.groupBy("arm", "task_id").agg(F.avg("passed").alias("rate"))
    return tasks.groupBy("arm").agg(F.round(100.0 * F.avg("rate"), 6).alias("macro_score"), F.count("*").alias("n_tasks"))


def pair_outcomes(arms: DataFrame) -> DataFrame:
    a, b = F.col("a_pass") == 1, F.col("b_pass") == 1
    return arms.agg(F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"))


def failure_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model", F.coalesce("error", "scorer").alias("outcome")).agg(F.count("*").alias("n"))


def scope_min_n(arms: DataFrame, scope: str, least: int = 8) -> DataFrame:
    """Scopes with enough independent clusters for an interval, all exploratory."""
    out = arms.groupBy(scope).agg(F.count_distinct("cluster_id").alias("n_clusters"))
    return out.withColumn("interval", F.col("n_clusters") >= least).withColumn("label", F.lit("EXPLORATORY"))


def draws(spark, seed: str, iterations: int, k: int) -> DataFrame:
    """(i, pick, times): cluster ordinals drawn with replacement in each iteration.

    sha256 of "bootstrap-v1", seed, i and the draw's number, modulo k, folded 32 bits at a time.
    """
    grid = spark.range(iterations * k).select(F.expr(f"id div {k}").alias("i"), (F.col("id") % k).alias("j"))
    return _drawn(grid, F.lit(seed), F.lit(k), "i").groupBy("i", "pick").agg(F.count("*").alias("times"))


def _drawn(grid: DataFrame, seed: Column, k: Column, *kept: str) -> DataFrame:
    """The ``kept`` columns and the pick of every (i, j)."""
    digest = F.sha2(F.concat_ws("\0", F.lit("bootstrap-v1"), seed, F.col("i").cast("string"), F.col("j").cast("string")), 256)
    pick = F.lit(0).cast("long")
    for at in range(1, 65, 8):
        pick = (pick * F.lit(4294967296) + F.conv(F.substring("h", at, 8), 16, 10).cast("long")) % k
    # the digest has a projection of its own, since eight terms name it
    return grid.select("*", digest.alias("h")).select(*kept, pick.alias("pick"))


def cluster_bootstrap(arms: DataFrame, seed: str, iterations: int = 10_000) -> DataFrame:
    """(i, delta): the equal-task macro delta of each resample of whole clusters.

    Tasks are summed by cluster first and weighted by how often the cluster is
    drawn, which equals expanding the repeated clusters.  There are
    iterations x clusters draws, so numbering the clusters in one task is the
    least of it.
    """
    tasks = arms.groupBy("cluster_id", "task_id").agg((F.avg("a_pass") - F.avg("b_pass")).alias("d"))
    clusters = tasks.groupBy("cluster_id").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    ordered = clusters.withColumn("pick", (F.row_number().over(Window.orderBy("cluster_id")) - 1).cast("long"))
    k = ordered.count()
    joined = draws(arms.sparkSession, seed, iterations, k).join(ordered, "pick")
    return joined.groupBy("i").agg((100 * F.sum(F.col("d") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("delta"))


def scoped_bootstrap(arms: DataFrame, seed: str, iterations: int = 10_000) -> DataFrame:
    """(scope, i, delta): ``cluster_bootstrap`` of every scope of arms(scope, ...) at once, with the seed ``seed/scope``.

    One pass draws for all scopes: a sparse matrix of how often each iteration
    of each scope takes a cluster meets the sums of the clusters.  Iterations
    are dealt over all tasks, clusters numbered by prefix counts.
    """
    tasks = arms.groupBy("scope", "cluster_id", "task_id").agg((F.avg("a_pass") - F.avg("b_pass")).alias("d"))
    clusters = tasks.groupBy("scope", "cluster_id").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    ordered = numbered_by(clusters, ["scope"], ["cluster_id"], "pick")
    sizes = ordered.groupBy("scope").agg(F.count("*").alias("k"))
    turns = sizes.select("scope", "k", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i")).repartition("scope", "i")
    grid = turns.select("scope", "k", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    names = F.concat(F.lit(f"{seed}/"), F.col("scope").cast("string"))
    drawn = _drawn(grid, names, F.col("k"), "scope", "i").groupBy("scope", "i", "pick").agg(F.count("*").alias("times"))
    joined = drawn.join(ordered, ["scope", "pick"])
    return joined.groupBy("scope", "i").agg((100 * F.sum(F.col("d") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("delta"))


def interval(deltas: DataFrame, low: int = 249, high: int = 9749, by: tuple[str, ...] = ()) -> DataFrame:
    ranked = deltas.groupBy(*by).agg(F.sort_array(F.collect_list("delta")).alias("s"))  # a bounded list: an entry per iteration
    return ranked.select(*by, F.round(F.get("s", F.lit(low)), 6).alias("low"), F.round(F.get("s", F.lit(high)), 6).alias("high"))


def ranks(iterations: int, scopes: int) -> tuple[int, int]:
    """Zero-based ends of an interval shared by several scopes."""
    q = 0.025 / scopes
    return max(1, int(iterations * q)) - 1, min(iterations, -int(-iterations * (1 - q) // 1)) - 1


def superiority(bounds: DataFrame, margin: float = 5.0) -> DataFrame:
    return bounds.withColumn("decision", F.when(F.col("low") > margin, "CANDIDATE_ADVANTAGE").when(F.col("high") < -margin, "REFERENCE_ADVANTAGE").otherwise("INCONCLUSIVE"))


def non_inferiority(bounds: DataFrame, margin: float = 5.0) -> DataFrame:
    return bounds.withColumn("decision", F.when(F.col("low") > -margin, "CANDIDATE_ELIGIBLE").when(F.col("high") < -margin, "REFERENCE_REQUIRED").otherwise("UNRESOLVED"))


def scope_decisions(arms: DataFrame, seed: str, scopes: int, iterations: int = 10_000, margin: float = 5.0) -> DataFrame:
    """(scope, low, high, decision): non-inferiority of arms(scope, ...) in each of the plan's ``scopes`` scopes, which share the error."""
    if arms.select("scope").distinct().limit(scopes + 1).count() > scopes:
        raise ValueError(f"more scopes than the {scopes} of the plan")
    return non_inferiority(interval(scoped_bootstrap(arms, seed, iterations), *ranks(iterations, scopes), by=("scope",)), margin)


def scope_intervals(arms: DataFrame, seed: str, least: int = 8, iterations: int = 10_000) -> DataFrame:
    """(scope, n_clusters, low, high, label): 95 % intervals of all scopes with ``least`` clusters, exploratory and each for itself."""
    enough = scope_min_n(arms, "scope", least).where("interval").drop("interval")
    chosen = arms.join(enough.select("scope"), "scope", "left_semi")
    return enough.join(interval(scoped_bootstrap(chosen, seed, iterations), *ranks(iterations, 1), by=("scope",)), "scope").select("scope", "n_clusters", "low", "high", "label")


def block_schedule(tasks: DataFrame, models: DataFrame, seed: str) -> DataFrame:
    """tasks(family, task_id, sample_k) and models(model): every block's models in turn.

    Blocks stand in digest order; a family's base order of models is rotated
    left by the block's place in its family.
    """

    def digest(*parts):
        return F.sha2(F.concat_ws("\0", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)

    blocks = tasks.withColumn("digest", digest("schedule-block-v1", seed, F.col("family"), F.col("task_id"), F.col("sample_k")))
    order = ["digest", "family", "task_id", "sample_k"]
    blocks = numbered_by(blocks, ["family"], order, "family_ordinal").withColumn("family_ordinal", F.col("family_ordinal").cast("int"))
    base = tasks.select("family").distinct().crossJoin(models)  # configuration
    base = base.withColumn("m", digest("schedule-model-v1", seed, F.col("family"), F.col("model")))
    mine = Window.partitionBy("family")
    base = base.withColumn("at", F.row_number().over(mine.orderBy("m", "model")) - 1).withColumn("n", F.count("*").over(mine))
    placed = blocks.join(base, "family").withColumn("position", F.expr("pmod(at - family_ordinal, n)").cast("int"))
    return placed.select("family", "task_id", "sample_k", "digest", "family_ordinal", "model", "position")
