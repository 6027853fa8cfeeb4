"""Prompts, templates and token ids for training rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollforge.functions.text import col, words

# Instructions and templates that prompts consist of.
MATH_SYSTEM = "You are a helpful math tutor. Solve the following problem step by step.\nShow your work clearly, explaining each step of your reasoning.\nAt the end, provide your final answer after '#### '."
CODE_SYSTEM = "You are an expert programmer. Solve the following coding problem.\nThink through the problem step by step before writing code.\nExplain your approach, then provide the complete solution in a Python code block."
MATH_TASK = "Solve this math problem step by step. Show your work and end with #### followed by the answer."
CODE_TASK = "Solve this coding problem. Explain your approach and provide the solution."
STEP_SEPARATORS = ["\n", "Step", "Therefore", "So,", "Thus,"]
IGNORED = -100


def format_prompt(problem: Column | str, kind: str = "math", few_shot: Column | None = None) -> Column:
    """System, example turns and the problem as tagged text. few_shot: array<struct<problem, solution>>."""
    system = MATH_SYSTEM if kind == "math" else CODE_SYSTEM
    shots = F.lit("") if few_shot is None else F.array_join(F.transform(few_shot, lambda x: F.concat(F.lit("<|user|>\n"), x["problem"], F.lit("\n<|assistant|>\n"), x["solution"], F.lit("\n"))), "")
    return F.concat(F.lit(f"<|system|>\n{system}\n"), shots, F.lit("<|user|>\n"), col(problem), F.lit("\n<|assistant|>\n"))


def format_chat_example(prompt: Column | str, response: Column | str) -> Column:
    return F.concat(F.lit("User: "), F.coalesce(col(prompt), F.lit("")), F.lit("\n\nAssistant: "), F.coalesce(col(response), F.lit("")))


def format_template(problem: Column | str, kind: str = "math") -> Column:
    return F.concat(F.lit(f"{MATH_TASK if kind == 'math' else CODE_TASK}\n\nProblem: "), col(problem), F.lit("\n\nSolution:"))


def fan_out_paths(problems: DataFrame, n: int) -> DataFrame:
    """n rows for each problem, numbered from 0."""
    return problems.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def to_sft_format(samples: DataFrame) -> DataFrame:
    """prompt and completion of correct rows."""
    return samples.where(F.coalesce("is_correct", F.lit(True))).select(F.col("problem").alias("prompt"), F.col("reasoning").alias("completion"))


def vocabulary(texts: DataFrame, text: str, size: int) -> DataFrame:
    """word, id of the most frequent words, ids from 1; 0 is left for all others. Its length is the given size at most."""
    counts = texts.select(F.explode(words(text)).alias("word")).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(size)
    return top.select("word", F.row_number().over(Window.orderBy(F.desc("count"), "word")).alias("id"))


def encoded(rows: DataFrame, key: list[str], texts: dict[str, str], vocab: DataFrame) -> DataFrame:
    """rows with an id array for each text column ({text column: id column}); a null text gives null, unknown words 0.

    All texts' words meet the vocabulary in one join; its size is bounded where it is made, so it goes to every task.
    """
    said = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(t).alias("text")) for i, t in enumerate(texts)]))
    tokens = rows.select(*key, said.alias("said")).select(*key, "said.field", F.posexplode(words("said.text")).alias("place", "word"))
    known = tokens.join(F.broadcast(vocab), "word", "left").select(*key, "field", "place", F.coalesce("id", F.lit(0)).alias("id"))
    lists = known.groupBy(*[F.col(k).alias(f"own_{k}") for k in key]).agg(F.array_sort(F.collect_list(F.struct("field", "place", "id"))).alias("coded"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in key])
    joined = rows.hint("merge").join(lists.hint("merge"), same, "left")
    none = F.array().cast("array<int>")
    of = lambda i: F.transform(F.filter("coded", lambda x: x["field"] == i), lambda x: x["id"])
    return joined.select(*rows.columns, *[F.when(F.col(t).isNotNull(), F.coalesce(of(i), none)).alias(out) for i, (t, out) in enumerate(texts.items())])


def encode_pair(prompt: Column, response: Column, max_prompt: int = 512, max_length: int = 2048) -> Column:
    """struct(input_ids, attention_mask, labels) of id arrays: the prompt's labels are ignored."""
    p = F.slice(prompt, 1, max_prompt)
    r = F.slice(response, F.lit(1), F.greatest(F.lit(max_length) - F.size(p), F.lit(0)))
    ids = F.concat(p, r)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), F.concat(F.transform(p, lambda _: F.lit(IGNORED)), r).alias("labels"))


def pad(ids: Column, length: int, value: int | str = 0) -> Column:
    """Cut or filled to one length, with a value of the ids' type. What fills is one constant array."""
    kept = F.slice(ids, 1, length)
    return F.slice(F.concat(kept, F.array_repeat(F.lit(value), length)), 1, length)


def padded_text(ids: Column, length: int, value: str = "0") -> Column:
    """array_join(pad(ids, length, value), ","), for ids that are text; what fills is repeated text, not elements."""
    kept = F.slice(ids, 1, length)
    more = length - F.size(kept)
    filled = F.array(F.concat(F.lit(value), F.repeat(F.lit(f",{value}"), more - 1)))
    return F.array_join(F.concat(kept, F.when(more > 0, filled).otherwise(F.array().cast("array<string>"))), ",")


def encode_reward_text(prompt: Column | str, response: Column | str) -> Column:
    return F.concat_ws("\n", col(prompt), col(response))


def tokenize_batch(rows: DataFrame, key: list[str], vocab: DataFrame, max_length: int = 2048) -> DataFrame:
    """Rows with input_ids and attention_mask of their text, else reasoning; key names a row."""
    given = [F.col(c) for c in ("text", "reasoning") if c in rows.columns]
    coded = encoded(rows.withColumn("text_", F.coalesce(*given, F.lit(""))), key, {"text_": "input_ids"}, vocab).drop("text_")
    return coded.withColumn("input_ids", F.slice("input_ids", 1, max_length)).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def tokenize_subwords(rows: DataFrame, tokenizer: Callable[[Column], Column], max_length: int = 2048) -> DataFrame:
    """tokenize_batch with a model's own tokenizer (functions.hooks.tokenizer_hook). No row moves; a row without a text passes with nulls."""
    given = [F.col(c) for c in ("text", "reasoning") if c in rows.columns]
    coded = rows.withColumn("input_ids", F.slice(tokenizer(F.coalesce(*given)), 1, max_length))
    return coded.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def tokenize_pairs(rows: DataFrame, key: list[str], vocab: DataFrame, max_length: int = 2048) -> DataFrame:
    """Rows with prompt, chosen and rejected as id arrays, the prompt up to half the length; a row that lacks one of them passes with nulls."""
    names = {"prompt": max_length // 2, "chosen": max_length, "rejected": max_length}
    coded = encoded(rows, key, {c: f"{c}_input_ids" for c in names}, vocab)
    whole = F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    return coded.withColumns({f"{c}_input_ids": F.when(whole, F.slice(f"{c}_input_ids", 1, n)) for c, n in names.items()})


def collate_batch(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per batch_id: a format tag and lists of lists, in the rows' places. Rows without a mask have an empty one."""
    pairs = {"chosen_input_ids", "rejected_input_ids"} <= set(rows.columns)
    lists = ["prompt_input_ids", "chosen_input_ids", "rejected_input_ids"] if pairs else ["input_ids", "attention_mask"]
    if not pairs and "attention_mask" not in rows.columns:
        rows = rows.withColumn("attention_mask", F.array().cast("array<int>"))
    held = F.array_sort(F.collect_list(F.struct("place", *lists)))
    out = rows.groupBy(*by, "batch_id").agg(held.alias("held"), F.count("*").alias("n_rows"))
    return out.select(*by, "batch_id", "n_rows", F.lit("dpo" if pairs else "standard").alias("format"), *[F.col("held")[c].alias(c) for c in lists])


def step_boundaries(text: Column | str) -> Column:
    """Sorted distinct character offsets of step separators."""
    c = col(text)

    def starts(mark: str) -> Column:
        """Each part but the last ends where a separator starts."""
        parts, size = F.split(c, mark), len(mark)
        none = F.array().cast("array<int>")
        return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), none, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)) + size, F.lit(0)) + F.length(x))))

    offsets = [starts(mark) for mark in STEP_SEPARATORS]
    return F.array_sort(F.array_distinct(F.concat(*offsets)))


def step_rewards_align(text: Column | str, offsets: Column, n_tokens: Column, prompt_tokens: Column) -> Column:
    """Token places of character offsets: words before them, after the prompt; places past the sequence are dropped."""
    places = F.transform(offsets, lambda at: prompt_tokens + F.size(F.filter(F.split(F.substring(col(text), F.lit(1), at), r"\s+"), lambda w: w != "")))
    return F.filter(places, lambda p: p < n_tokens)


def best_prefix_steps(text: Column | str, offsets: Column, rewards: Column, final: Column, threshold: float = 0.5) -> Column:
    """struct(prefix, reward): cut at the step of the highest reward that reaches the threshold, the first of equals."""
    steps = F.filter(F.arrays_zip(rewards.alias("reward"), F.transform(offsets, lambda x: -x).alias("back")), lambda s: (s["reward"] >= threshold) & s["back"].isNotNull())
    best = F.array_max(steps)
    return F.when(best.isNotNull(), F.struct(F.substring(col(text), F.lit(1), -best["back"]).alias("prefix"), best["reward"].alias("reward"))).otherwise(F.struct(col(text).alias("prefix"), final.alias("reward")))
