"""Preference pairs: chosen and rejected samples of one problem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rollforge.functions import text as tx
from rollforge.sources.scratch import written


#: Problems with no more pairs meet with their texts, in one shuffle; a text is then held for each of its pairs.
FEW_PAIRS = 16
#: About as many pairs as one task makes; a problem with more is dealt out over several.
PAIRS_PER_TASK = 1_000_000
#: Of a problem with more pairs only those are scored that may be among its best; about as many are looked at by a task.
SCORED_PAIRS, BOUNDED_PER_TASK, MOST_TASKS = 10_000, 20_000_000, 10_000
#: A row's frequent words are kept as bits: 64 for each long, those of its own problem.
MASK_LONGS = 8
#: Rows whose pairs give the first bar of a large problem: the first ones in order and the largest ones, chosen and rejected.
FIRST, LARGEST = (8, 32), (24, 96)
# The rejected text where a benchmark's problem has no wrong sample.
MADE_UP = "Let me work through this step by step...\n\nAfter careful calculation, the answer is "


def _held(samples: DataFrame) -> DataFrame:
    """samples graded and split into words once, as a written table: row_, problem_id, sample_idx, ok, confidence, tokens and the texts.

    Read back, the two sides of a join take only the columns that they need, and no verdict is computed again.
    """
    given = [F.col(c) for c in ("prompt", "problem") if c in samples.columns]
    sure = [F.col(c) for c in ("confidence", "verification_confidence") if c in samples.columns]
    return written(
        samples.select(
            F.monotonically_increasing_id().alias("row_"), "problem_id", "sample_idx", F.coalesce("is_correct", F.lit(False)).alias("ok"), F.coalesce(*sure, F.lit(0.0)).alias("confidence"),
            tx.word_set(F.coalesce("reasoning", F.lit(""))).alias("tokens"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce(*given, F.lit("")).alias("prompt"),
        ),
        "sides",
    )


def _meet(held: DataFrame, *more: str) -> DataFrame:
    """Every correct row of a problem with every incorrect one: problem_id, c_ and r_ columns. Only ids and the columns asked for move.

    The chosen rows of a problem with very many pairs are dealt out over several tasks, and its rejected ones go to each.
    """
    right, wrong = F.count_if("ok"), F.count_if(~F.col("ok"))
    sizes = held.groupBy("problem_id").agg(right.alias("c"), wrong.alias("r")).where("c > 0 and r > 0")
    parts = F.least(F.ceil(F.col("c").cast("double") * F.col("r") / PAIRS_PER_TASK), F.col("c")).cast("int")
    sizes = sizes.select("problem_id", parts.alias("parts"))
    side = lambda p, flag: held.where(flag).select("problem_id", *[F.col(c).alias(f"{p}_{c}") for c in ("row_", "sample_idx", *more)]).hint("merge").join(sizes.hint("merge"), "problem_id")
    chosen = side("c", F.col("ok")).withColumn("part", F.pmod(F.xxhash64("c_row_"), F.col("parts")).cast("int")).drop("parts")
    rejected = side("r", ~F.col("ok")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return chosen.hint("merge").join(rejected.hint("merge"), ["problem_id", "part"]).drop("part")


def _with_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs with prompt, chosen and rejected, which only now move."""
    side = lambda p, *names: held.select(F.col("row_").alias(f"{p}_row_"), *[F.col(a).alias(b) for a, b in names]).hint("merge")
    return pairs.hint("merge").join(side("c", ("reasoning", "chosen"), ("prompt", "prompt")), "c_row_").hint("merge").join(side("r", ("reasoning", "rejected")), "r_row_")


def _with_few_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """_with_texts of pairs that are few beside the rows (a written table): only the texts of rows in a pair leave their place."""
    ends = written(pairs.select(F.explode(F.array("c_row_", "r_row_")).alias("row_")).distinct(), "ends")
    return _with_texts(pairs, written(held.select("row_", "reasoning", "prompt").join(ends, "row_", "left_semi"), "texts"))


def rejection_pairs(samples: DataFrame) -> DataFrame:
    """All correct x incorrect of a problem: problem_id, c_idx, r_idx."""
    return _meet(_held(samples)).select("problem_id", F.col("c_sample_idx").alias("c_idx"), F.col("r_sample_idx").alias("r_idx"))


def _diverse(held: DataFrame, least: float, empty: float, *more: str) -> DataFrame:
    both = _meet(held, "tokens", *more)
    return both.withColumn("diversity_score", tx.diversity_of(F.col("c_tokens"), F.col("r_tokens"), empty)).drop("c_tokens", "r_tokens").where(F.col("diversity_score") >= least)


def _by_size(held: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The rows of problems with few pairs, those of the others (none: there are no others), and the others' numbers of chosen and rejected rows (c, r; a written table)."""
    sizes = held.groupBy("problem_id").agg(F.count_if("ok").alias("c"), F.count_if(~F.col("ok")).alias("r"))
    others = written(sizes.where(F.col("c").cast("double") * F.col("r") > FEW_PAIRS), "others")
    if others.isEmpty():
        return held, None, others
    names = others.select("problem_id")
    return held.join(names, "problem_id", "left_anti"), held.join(names, "problem_id", "left_semi"), others


def _diverse_few(rows: DataFrame, least: float, empty: float) -> DataFrame:
    """What _with_texts(_diverse()) gives, with each row moved once: a problem's pairs are made, and can be ranked, where its rows meet."""
    side = lambda p, flag, *names: rows.where(flag).select("problem_id", *[F.col(c).alias(f"{p}_{c}") for c in ("row_", "sample_idx", "confidence", "tokens")], *[F.col(a).alias(b) for a, b in names]).hint("merge")
    both = side("c", F.col("ok"), ("reasoning", "chosen"), ("prompt", "prompt")).join(side("r", ~F.col("ok"), ("reasoning", "rejected")), "problem_id")
    return both.withColumn("diversity_score", tx.diversity_of(F.col("c_tokens"), F.col("r_tokens"), empty)).drop("c_tokens", "r_tokens").where(F.col("diversity_score") >= least)


def pair_join(samples: DataFrame, least: float = 0.1) -> DataFrame:
    """Correct x incorrect with at least that diversity, with prompt and both texts; empty texts have none."""
    held = _held(samples)
    few, many, _ = _by_size(held)
    found = _diverse_few(few, least, 0.0)
    if many is not None:
        found = found.unionByName(_with_texts(_diverse(many, least, 0.0, "confidence"), many).select(*found.columns))
    return found.select("problem_id", F.col("c_sample_idx").alias("c_idx"), F.col("r_sample_idx").alias("r_idx"), "prompt", "chosen", "rejected", "diversity_score")


def _best_first() -> WindowSpec:
    side = lambda p: [F.desc(f"{p}_confidence"), F.asc_nulls_last(f"{p}_sample_idx"), F.col(f"{p}_row_")]
    return Window.partitionBy("problem_id").orderBy(F.desc("diversity_score"), *side("c"), *side("r"))


def _place(p: str) -> Column:
    """A row's place among those of its side that tie: smaller is better."""
    keys = [-F.col(f"{p}_confidence"), F.col(f"{p}_sample_idx").isNull(), F.col(f"{p}_sample_idx"), F.col(f"{p}_row_")]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys)])


def _masked(rows: DataFrame) -> DataFrame:
    """problem_id, row_, ok, sample_idx, confidence, n (words), m0.. (which of its problem's frequent words a row has), as a written table."""
    said = rows.select("problem_id", "row_", F.explode("tokens").alias("word"))
    often = Window.partitionBy("problem_id").orderBy(F.desc("count"), "word")
    common = said.groupBy("problem_id", "word").count().withColumn("place", F.row_number().over(often)).where(F.col("place") <= 64 * MASK_LONGS)
    common = written(common.select("problem_id", "word", (F.col("place") - 1).alias("place")), "common")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    masks = said.join(common, ["problem_id", "word"]).groupBy("row_").agg(*[F.bit_or(F.when(F.floor(F.col("place") / 64) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{j}") for j in range(MASK_LONGS)])
    thin = rows.select("problem_id", "row_", "ok", "sample_idx", "confidence", F.size("tokens").alias("n")).hint("merge").join(masks.hint("merge"), "row_", "left")
    return written(thin.fillna(0, [f"m{j}" for j in range(MASK_LONGS)]), "thin")


def _scored(pairs: DataFrame, rows: DataFrame, empty: float) -> DataFrame:
    """Pairs (c_row_, r_row_; a written table) with diversity_score; word sets are fetched for these pairs alone, and no others move."""
    ends = written(pairs.select(F.explode(F.array("c_row_", "r_row_")).alias("row_")).distinct(), "ends")
    words = written(rows.select("row_", "tokens").join(ends, "row_", "left_semi"), "words")
    side = lambda p: words.select(F.col("row_").alias(f"{p}_row_"), F.col("tokens").alias(f"{p}_tokens"))
    both = pairs.join(side("c"), "c_row_").join(side("r"), "r_row_")
    return both.withColumn("diversity_score", tx.diversity_of(F.col("c_tokens"), F.col("r_tokens"), empty)).drop("c_tokens", "r_tokens")


def _best_of_large(rows: DataFrame, sizes: DataFrame, least: float, most: int, empty: float) -> DataFrame:
    """The pairs of problems with very many that may be among their best, scored; all of the best are there.

    Some pairs are scored first; the last of a problem's best so far is its bar. The number of frequent words that two
    rows share bounds their score from above, without their sets, and only pairs whose bound passes the bar are scored.
    Every pair is looked at once: a problem's rows are dealt out over a grid of tasks.
    """
    thin = _masked(rows)
    named = lambda p, df, *more: df.select("problem_id", *[F.col(c).alias(f"{p}_{c}") for c in ("row_", "sample_idx", "confidence", *more)])
    side = {"c": thin.where("ok"), "r": thin.where(~F.col("ok"))}

    def some(p: str, i: int) -> DataFrame:
        cut = lambda order, n: side[p].withColumn("nth", F.row_number().over(Window.partitionBy("problem_id").orderBy(*order, "row_"))).where(F.col("nth") <= n).drop("nth")
        return named(p, cut([F.desc("confidence"), F.asc_nulls_last("sample_idx")], FIRST[i]).unionByName(cut([F.desc("n")], LARGEST[i])).distinct())

    held = lambda p, i: written(some(p, i), "tried").join(rows.select(F.col("row_").alias(f"{p}_row_"), F.col("tokens").alias(f"{p}_tokens")), f"{p}_row_").hint("merge")
    tried = held("c", 0).join(held("r", 1), "problem_id").withColumn("diversity_score", tx.diversity_of(F.col("c_tokens"), F.col("r_tokens"), empty))
    tried = written(tried.drop("c_tokens", "r_tokens"), "tried").where(F.col("diversity_score") >= least)
    nth = tried.withColumn("nth", F.row_number().over(_best_first())).where(F.col("nth") == most)
    bars = nth.select("problem_id", F.col("diversity_score").alias("bar"), _place("c").alias("last"))

    cells = F.ceil(F.sqrt(F.col("c").cast("double") * F.col("r") / BOUNDED_PER_TASK)).cast("int")
    grid = written(sizes.hint("merge").join(bars.hint("merge"), "problem_id", "left").select("problem_id", "bar", "last", cells.alias("cells")), "grid")
    tasks = min(int(grid.agg(F.sum(F.col("cells").cast("long") * F.col("cells"))).first()[0]) * 2, MOST_TASKS)
    own = lambda p: F.pmod(F.xxhash64(f"{p}_row_"), F.col("cells")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    words = ["n", *[f"m{j}" for j in range(MASK_LONGS)]]
    # 1 - shared / (words - shared) reaches the bar where shared <= words * x / (1 + x), x = 1 - bar; it passes it where shared is less
    x = F.greatest(1 - F.coalesce("bar", F.lit(float(least))), F.lit(0.0))
    slack = F.when(F.col("bar").isNull() | (_place("c") <= F.col("last")), 1e-9).otherwise(-1e-9)
    dealt = lambda df: df.repartition(tasks, "problem_id", "down", "across").hint("merge")
    chosen = named("c", side["c"], *words).join(grid, "problem_id").withColumns({"share": x / (1 + x), "slack": slack, "down": own("c")}).withColumn("across", every).drop("cells", "bar", "last")
    rejected = named("r", side["r"], *words).join(grid.select("problem_id", "cells"), "problem_id").withColumn("across", own("r")).withColumn("down", every).drop("cells")
    shared = reduce(Column.__add__, [F.bit_count(F.col(f"c_m{j}").bitwiseAND(F.col(f"r_m{j}"))) for j in range(MASK_LONGS)])
    met = dealt(chosen).join(dealt(rejected), ["problem_id", "down", "across"]).where(shared <= F.greatest(F.col("c_n") + F.col("r_n"), F.lit(1)) * F.col("share") + F.col("slack"))
    ids = [f"{p}_{c}" for p in "cr" for c in ("row_", "sample_idx", "confidence")]
    return _scored(written(met.select("problem_id", *ids), "may_be_best"), rows, empty).where(F.col("diversity_score") >= least)


def smart_pair_join(samples: DataFrame, least: float = 0.2, most: int = 5) -> DataFrame:
    """The most diverse pairs of each problem, with the chosen sample's prompt and both texts. Empty texts count as 1.

    Equal pairs go by the chosen row's confidence and place, then the rejected row's. Rows of problems with more than a
    few pairs are ranked by ids and word sets; only the pairs that stay fetch their texts. Of problems with very many
    pairs most are never scored.
    """
    held = _held(samples)
    few, many, others = _by_size(held)
    first = lambda found: found.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= most)
    best = first(_diverse_few(few, least, 1.0))
    if many is not None:
        large = others.where(F.col("c").cast("double") * F.col("r") > SCORED_PAIRS)
        if large.isEmpty():
            found = _diverse(many, least, 1.0, "confidence")
        else:
            names = large.select("problem_id")
            found = _diverse(many.join(names, "problem_id", "left_anti"), least, 1.0, "confidence")
            found = found.unionByName(_best_of_large(many.join(names, "problem_id", "left_semi"), large, least, most, 1.0).select(*found.columns))
        best = best.unionByName(_with_few_texts(written(first(found), "ranked"), many).select(*best.columns))
    return best.select(
        "problem_id", "rank", F.col("c_sample_idx").alias("c_idx"), F.col("r_sample_idx").alias("r_idx"), "prompt", "chosen", "rejected",
        "diversity_score", F.col("c_confidence").alias("chosen_confidence"), F.col("r_confidence").alias("rejected_confidence"),
    )


def ranked(samples: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return samples.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def confidence_rank(samples: DataFrame) -> DataFrame:
    """Each side of a problem by confidence, in sample order between equals."""
    return ranked(samples, ["problem_id", "is_correct"], [F.desc_nulls_last("confidence"), F.col("sample_idx")])


def capped_pairs(samples: DataFrame, per_side: int = 2) -> DataFrame:
    """The first few of each side, paired. Each side is cut before rows meet.

    What stays is written: a side's filter would else go below the ranks and judge every row anew, for each side.
    """
    slim = samples.select("problem_id", "sample_idx", "is_correct")
    few = written(ranked(slim, ["problem_id", "is_correct"], [F.col("sample_idx")]).where(F.col("rank") <= per_side), "few")
    chosen = few.where("is_correct").select("problem_id", F.col("sample_idx").alias("c_idx"))
    return chosen.join(few.where("not is_correct").select("problem_id", F.col("sample_idx").alias("r_idx")), "problem_id")


def both_sides(samples: DataFrame) -> DataFrame:
    """Rows of problems that have both correct and incorrect samples."""
    good = samples.groupBy("problem_id").agg(F.bool_or("is_correct").alias("c"), F.bool_or(~F.col("is_correct")).alias("r")).where("c and r")
    return samples.join(good, "problem_id", "left_semi")


def preference_from_benchmark(problems: DataFrame, samples: DataFrame, wrong: Column) -> DataFrame:
    """problem_id, chosen (the benchmark's solution), rejected (the first wrong sample, else the truth plus 7 in words)."""
    first = samples.where(wrong).groupBy("problem_id").agg(F.min_by("reasoning", "sample_idx").alias("wrong_text"))
    off = F.coalesce((F.col("answer").try_cast("double").cast("long") + 7).cast("string"), F.lit("999"))
    made = F.concat(F.lit(MADE_UP), off, F.lit("."))
    return problems.join(first, "problem_id", "left").select("problem_id", F.col("solution").alias("chosen"), F.coalesce("wrong_text", made).alias("rejected"))


def rejudge_rewards(pairs: DataFrame, rewards: DataFrame) -> DataFrame:
    """Pairs with the reward of each side. rewards: problem_id, sample_idx, reward; written, so that each is computed once for both sides."""
    pairs, rewards = written(pairs, "capped"), written(rewards.select("problem_id", "sample_idx", "reward"), "rewards")
    side = lambda i, name: rewards.select("problem_id", F.col("sample_idx").alias(i), F.col("reward").alias(name))
    return pairs.join(side("c_idx", "chosen_reward"), ["problem_id", "c_idx"], "left").join(side("r_idx", "rejected_reward"), ["problem_id", "r_idx"], "left")


def to_dpo_format(pairs: DataFrame) -> DataFrame:
    """prompt, chosen, rejected with empty defaults."""
    names = [c for c in ("prompt", "problem") if c in pairs.columns]
    return pairs.select(F.coalesce(*map(F.col, names), F.lit("")).alias("prompt"), F.coalesce("chosen", F.lit("")).alias("chosen"), F.coalesce("rejected", F.lit("")).alias("rejected"))
