"""Grading whole tables, in steps that each compute an intermediate once.

Written as one nested expression, the same extraction would be repeated wherever its result is used, and the generated
code would outgrow what the JVM compiles. Columns named in STEP are dropped again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollforge.functions import grade
from rollforge.functions.algebra import same_expression

STEP = "_step_"


def _dropped(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(STEP)])


def with_numeric(df: DataFrame, source: str, out: str) -> DataFrame:
    """The number that an answer stands for, or null."""
    return _dropped(df.withColumn(f"{STEP}n", grade.normalize_answer(source)).withColumn(out, grade.numeric_of(F.col(f"{STEP}n"))))


def with_number_comparison(df: DataFrame, predicted: str, expected: str, tolerance: float = 1e-6) -> DataFrame:
    """Adds is_equal and closeness."""
    p, e = F.col(f"{STEP}p"), F.col(f"{STEP}e")
    step = df.withColumns({f"{STEP}pt": grade.normalize_answer(predicted), f"{STEP}et": grade.normalize_answer(expected)})
    step = step.withColumns({f"{STEP}p": grade.numeric_of(F.col(f"{STEP}pt")), f"{STEP}e": grade.numeric_of(F.col(f"{STEP}et"))})
    step = step.withColumn("is_equal", grade.same_number(p, e, tolerance))
    return _dropped(step.withColumn("closeness", F.when(F.col("is_equal"), 1.0).otherwise(grade.closeness(p, e))))


def with_math_verdict(df: DataFrame, predicted: str, expected: str, out: str = "verdict", algebra: bool = False) -> DataFrame:
    """out: struct(status, expected, predicted, confidence); equal text without case is correct, else equal numbers.

    With algebra, what is neither is compared as expressions (functions/algebra.py); texts that are none stay incorrect.
    """
    whole = lambda c: F.coalesce(F.nullif(grade.extract_final_answer(c), F.lit("")), F.col(c))
    step = df.withColumns({f"{STEP}pa": whole(predicted), f"{STEP}ea": whole(expected)})
    step = step.withColumns({f"{STEP}pn": grade.normalize_answer(f"{STEP}pa"), f"{STEP}en": grade.normalize_answer(f"{STEP}ea")})
    step = with_number_comparison_kept(step, f"{STEP}pn", f"{STEP}en")
    right = (F.lower(f"{STEP}pn") == F.lower(f"{STEP}en")) | F.col(f"{STEP}equal")
    step = step.withColumn(f"{STEP}ok", F.coalesce(right, F.lit(False)))
    if algebra:
        step = step.withColumn(f"{STEP}ok", F.col(f"{STEP}ok") | F.coalesce(same_expression(F.col(f"{STEP}pn"), F.col(f"{STEP}en"), ~F.col(f"{STEP}ok")), F.lit(False)))
    ok = F.col(f"{STEP}ok")
    verdict = F.struct(F.when(ok, "correct").otherwise("incorrect").alias("status"), F.col(f"{STEP}en").alias("expected"), F.col(f"{STEP}pn").alias("predicted"), F.when(ok, 1.0).otherwise(0.0).alias("confidence"))
    return _dropped(step.withColumn(out, verdict))


def with_number_comparison_kept(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """The step column "equal" alone, beside the other steps."""
    step = df.withColumns({f"{STEP}pt": grade.normalize_answer(predicted), f"{STEP}et": grade.normalize_answer(expected)})
    step = step.withColumns({f"{STEP}p": grade.numeric_of(F.col(f"{STEP}pt")), f"{STEP}e": grade.numeric_of(F.col(f"{STEP}et"))})
    return step.withColumn(f"{STEP}equal", grade.same_number(F.col(f"{STEP}p"), F.col(f"{STEP}e")))


def with_math_path_verdict(df: DataFrame, reasoning: str, expected: str, out: str = "verdict", penalize_parse_error: bool = False) -> DataFrame:
    """Grades the extracted answer; without one parse_error, of confidence 1 unless penalised."""
    step = with_math_verdict(df.withColumn("path_answer_", grade.extract_final_answer(reasoning)), "path_answer_", expected, "path_verdict_")
    lost = F.struct(F.lit("parse_error").alias("status"), F.col(expected).alias("expected"), F.lit(None).cast("string").alias("predicted"), F.lit(0.0 if penalize_parse_error else 1.0).alias("confidence"))
    return step.withColumn(out, F.when(F.col("path_answer_").isNull(), lost).otherwise(F.col("path_verdict_"))).drop("path_answer_", "path_verdict_")


def with_gsm8k_verdict(df: DataFrame, reasoning: str, expected: str, out: str = "verdict") -> DataFrame:
    """out: struct(status, expected, predicted, confidence) with numbers as doubles; within 0.001 is correct."""
    text = lambda c: F.replace(F.coalesce(F.nullif(grade.extract_gsm8k_answer(c), F.lit("")), F.col(c)), F.lit(","), F.lit(""))
    step = df.withColumns({f"{STEP}pt": text(reasoning), f"{STEP}et": text(expected)})
    step = step.withColumns({f"{STEP}p": grade.number(F.col(f"{STEP}pt")), f"{STEP}e": grade.number(F.col(f"{STEP}et"))})
    p, e = F.col(f"{STEP}p"), F.col(f"{STEP}e")
    gap = F.abs(p - e)
    status = F.when(gap < 0.001, "correct").when(gap.isNotNull(), "incorrect").otherwise("parse_error")
    verdict = F.struct(status.alias("status"), e.alias("expected"), p.alias("predicted"), F.when(gap >= 0.001, 0.0).otherwise(1.0).alias("confidence"))
    return _dropped(step.withColumn(out, verdict))


def verify_batch(paths: DataFrame, text: str = "reasoning", truth: str = "expected") -> DataFrame:
    """A table of paths with status, is_correct, verification_confidence and final_answer. No row moves."""
    judged = with_gsm8k_verdict(paths, text, truth, "path_verdict_")
    v = F.col("path_verdict_")
    return judged.select(*paths.columns, v["status"].alias("status"), (v["status"] == "correct").alias("is_correct"), v["confidence"].alias("verification_confidence"), v["predicted"].alias("final_answer"))
