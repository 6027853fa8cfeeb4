"""Groups, advantages, objectives and training logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.operators.ordinals import numbered
from rollforge.sources.scratch import written


def group_responses(rows: DataFrame) -> DataFrame:
    """prompt, chosen[], rejected[] in sample order; prompts that have both. rows: prompt, idx, is_chosen, response."""
    side = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("idx", "response")))), lambda x: x["response"])
    grouped = rows.groupBy("prompt").agg(side(F.col("is_chosen")).alias("chosen"), side(~F.col("is_chosen")).alias("rejected"))
    return grouped.where((F.size("chosen") > 0) & (F.size("rejected") > 0))


def group_advantage(rows: DataFrame, group_size: int = 8, epsilon: float = 1e-8) -> DataFrame:
    """prompt, idx, is_chosen, reward, advantage: the first half-groups of each side as +1 and -1, standardised.

    A group of one row has no deviation and a null advantage.
    """
    order = Window.partitionBy("prompt", "is_chosen").orderBy("idx")
    taken = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= group_size // 2)
    reward = F.when(F.col("is_chosen"), 1.0).otherwise(-1.0)
    group = Window.partitionBy("prompt")
    scored = taken.withColumn("reward", reward)
    return scored.select("prompt", "idx", "is_chosen", "reward", ((F.col("reward") - F.avg("reward").over(group)) / (F.stddev_samp("reward").over(group) + epsilon)).alias("advantage"))


def pairwise_ranking_loss(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of -log sigmoid(chosen - rejected), written so that large gaps do not overflow."""
    gap = F.col("chosen_score") - F.col("rejected_score")
    loss = F.log1p(F.exp(-F.abs(gap))) + F.greatest(-gap, F.lit(0.0))
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), F.avg((gap > 0).cast("double")).alias("accuracy"))


def sequence_logprob(logprobs: Column, ids: Column, pad: int) -> Column:
    """Mean log-probability over the tokens that are no padding; over at least one."""
    pairs = F.filter(F.arrays_zip(logprobs.alias("l"), ids.alias("i")), lambda x: x["i"] != pad)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["l"]) / F.greatest(F.size(pairs), F.lit(1))


def grpo_objective(rows: DataFrame, by: list[str], clip: float = 0.2, kl_weight: float = 0.1) -> DataFrame:
    """Loss, policy loss, mean divergence and mean ratio. rows: advantage, policy_lp, ref_lp."""
    ratio = F.exp(F.col("policy_lp") - F.col("ref_lp"))
    kept = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    gain = F.least(ratio * F.col("advantage"), kept * F.col("advantage"))
    policy, kl = -F.avg(gain), F.avg(F.col("ref_lp") - F.col("policy_lp"))
    return rows.groupBy(*by).agg((policy + kl_weight * kl).alias("loss"), policy.alias("policy_loss"), kl.alias("kl_divergence"), F.avg(ratio).alias("ratio_mean"))


def training_step_report(batches: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of batch metrics by optimiser step."""
    return batches.groupBy("worker", "step").agg(F.count("*").alias("batches"), *[F.avg(m).alias(m) for m in metrics])


def training_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Steps, first and final loss, reduction, margins, divergences; zero margins and divergences do not count."""
    first, last = F.min_by("loss", "step"), F.max_by("loss", "step")
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    step_of = lambda c: F.when(F.col(c) != 0, F.col("step"))
    early, late = F.min_by(some("margin"), step_of("margin")), F.max_by(some("margin"), step_of("margin"))
    return log.groupBy(*by).agg(
        F.count("*").alias("total_steps"), first.alias("initial_loss"), last.alias("final_loss"), (first - last).alias("loss_reduction"),
        F.coalesce(F.try_divide((first - last) * 100, first), F.lit(0.0)).alias("loss_reduction_pct"), F.coalesce(late, F.lit(0.0)).alias("final_reward_margin"),
        F.coalesce(late - early, F.lit(0.0)).alias("margin_improvement"), F.coalesce(F.avg(some("kl")), F.lit(0.0)).alias("avg_kl_divergence"), F.coalesce(F.max(some("kl")), F.lit(0.0)).alias("max_kl_divergence"),
    )


def training_flags(summary: DataFrame) -> DataFrame:
    """Labels on the loss's trend, the margin's sign and the divergence's bound."""
    signed = (F.col("initial_loss") < 0) | (F.col("final_loss") < 0)
    loss = F.when(signed & (F.col("final_loss") < F.col("initial_loss")), "improving").when(signed, "not_improving").when(F.col("loss_reduction_pct") > 10, "decreasing").when(F.col("loss_reduction_pct") > 0, "decreasing_slowly").otherwise("not_decreasing")
    margin = F.when(F.col("final_reward_margin") > 0, "positive").when(F.col("final_reward_margin") < 0, "negative").otherwise("none")
    kl = F.when(F.col("max_kl_divergence") < 0.5, "bounded").when(F.col("max_kl_divergence") < 1.0, "moderate").otherwise("high")
    return summary.withColumns({"loss_flag": loss, "margin_flag": margin, "kl_flag": kl})


def series_downsample(log: DataFrame, by: list[str], value: str, width: int) -> DataFrame:
    """Every (n div width)-th point, at most width of them, scaled to 0..1 over all points of the series."""
    marked = numbered(log.select(*by, "step", F.col(value).alias("value")), by, ["step"])
    stride = F.greatest(F.floor(F.col("place_n") / width), F.lit(1))
    kept = marked.where((F.col("place") % stride == 0) & (F.col("place") / stride < width))
    ends = log.groupBy(*[F.col(c).alias(f"own_{c}") for c in by]).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in by])
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return kept.hint("merge").join(ends.hint("merge"), same).select(*by, "step", "value", scaled.alias("scaled"))


def batch_assign(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """batch_id and place in it: consecutive batches of a fixed size within each key; the last may be shorter.

    Rows are numbered by range, so a key of any size is dealt out.
    """
    placed = numbered(rows, by, order).drop("place_n")
    return placed.withColumn("batch_id", F.floor(F.col("place") / size)).withColumn("place", F.col("place") % size)


def positional_split(rows: DataFrame, ordinal: str, share: float = 0.9) -> DataFrame:
    """split: train for the first share of rows by their ordinal, eval for the rest. Ordinals may have gaps or repeat."""
    placed = numbered(rows, [], [ordinal])
    return placed.withColumn("split", F.when(F.col("place") < F.floor(F.col("place_n") * share), "train").otherwise("eval")).drop("place", "place_n")


def running_totals(counts: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Cumulative sums over checkpoints; one row per checkpoint goes through the window."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({f"total_{v}": F.sum(v).over(upto) for v in values})


def hash_order(key: Column | str, seed: int) -> Column:
    """A reproducible shuffle: order by this."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")))


#: Hexadecimal digits that one pass over the hashes looks at: 65,536 counts.
DIGITS = 4


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int, out: str = "first") -> DataFrame:
    """rows with out: whether a row is among the first n by hash_order, then key, then as read. Nothing is sorted.

    Counts by the hash's next four digits narrow the cut to one value; a pass sends 65,536 counts to the driver and only
    looks at rows that share the digits found so far, so there are few. Rows of the very hash at the cut, which share
    their key but for clashes, are numbered by range.
    """
    hashed = written(rows.select(F.struct(*rows.columns).alias("row"), hash_order(f"row.{key}", seed).alias("h"), F.monotonically_increasing_id().alias("nth")), "hashed")
    found, left = "", n
    while len(found) < 32:
        digits = F.substring("h", len(found) + 1, DIGITS)
        counts = hashed.where(F.col("h").startswith(found)).groupBy(digits.alias("d")).count().collect()
        at = None
        for r in sorted(counts, key=lambda r: r.d):
            if r["count"] > left:
                at = r.d
                break
            left -= r["count"]
        if at is None:  # all rows fit
            return hashed.select("row.*", F.lit(True).alias(out))
        found += at
        if left == 0:
            return hashed.select("row.*", (F.col("h") < found).alias(out))
    same = numbered(hashed.where(F.col("h") == found).select("row", F.col(f"row.{key}").alias("k"), "nth"), [], ["k", "nth"])
    sure = hashed.where(F.col("h") != found).select("row.*", (F.col("h") < found).alias(out))
    return sure.unionByName(same.select("row.*", (F.col("place") < left).alias(out)))


def sample_problems(problems: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return first_by_hash(problems, key, n, seed, "first_").where("first_").drop("first_")


def shuffle_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """split: train for exactly int(share * n) rows of a reproducible shuffle, eval for the rest."""
    n = rows.count()
    return first_by_hash(rows, key, int(share * n), seed, "first_").withColumn("split", F.when(F.col("first_"), "train").otherwise("eval")).drop("first_")
