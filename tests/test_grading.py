import pytest
from pyspark.sql import functions as F

from rollforge.functions import grade
from rollforge.operators import grading


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("predicted", "expected", "status"),
    [("42", "42", "correct"), ("42.0", "42", "correct"), ("0.5", "1/2", "correct"), ("41", "42", "incorrect"), ("$100", "100 dollars", "correct"), ("x+1", "1+x", "incorrect"), ("1/0", "2", "incorrect")],
)
def test_grade_math(spark, predicted, expected, status):
    df = spark.createDataFrame([(predicted, expected)], "p string, e string")
    assert grading.with_math_verdict(df, "p", "e").first()["verdict"]["status"] == status


@pytest.mark.parametrize(
    ("text", "answer"),
    [
        ("The answer is 7. So \\boxed{42}", "42"), ("So the total is 42.\n#### 42", "42"), ("Therefore, the answer is 42.", "42"), ("a + b, total = 55", "55"), ("nothing here", None), ("the answer is 3.14", "3"),
        ("#### $5$\n", "5"), ("\\boxed{1} and \\boxed{2}", "2"),
    ],
)
def test_extract_final_answer(spark, text, answer):
    assert one(spark, grade.extract_final_answer("t"), t=text) == answer


@pytest.mark.parametrize(("text", "expected", "status", "confidence"), [("steps\n#### 20", "20", "correct", 1.0), ("1,234", "1234", "correct", 1.0), ("#### 3", "4", "incorrect", 0.0), ("nothing", "4", "parse_error", 1.0)])
def test_grade_gsm8k(spark, text, expected, status, confidence):
    df = spark.createDataFrame([(text, expected)], "p string, e string")
    verdict = grading.with_gsm8k_verdict(df, "p", "e").first()["verdict"]
    assert (verdict["status"], verdict["confidence"]) == (status, confidence)


def test_math_path_without_answer_is_a_parse_error(spark):
    df = spark.createDataFrame([("no idea", "4")], "p string, e string")
    assert grading.with_math_path_verdict(df, "p", "e").first()["verdict"]["confidence"] == 1.0
    assert grading.with_math_path_verdict(df, "p", "e", penalize_parse_error=True).first()["verdict"]["confidence"] == 0.0


def test_normalize_and_numbers(spark):
    assert one(spark, grade.normalize_answer("t"), t="$100") == "100"
    assert one(spark, grade.normalize_answer("t"), t="\\frac{1}{2}") == "12"
    assert one(spark, grade.normalize_answer("t"), t="1,234 miles") == "1234"
    assert one(spark, grade.number(F.col("t")), t="1_000") is None
    assert one(spark, grade.number(F.col("t")), t="1.0d") is None
    assert one(spark, grade.number(F.col("t")), t=" -1.5e3 ") == -1500.0
    assert one(spark, grade.number(F.col("t")), t=None) is None


@pytest.mark.parametrize(("step", "status"), [("2 + 2 = 4", "correct"), ("2 * 3 = 7", "incorrect"), ("x = 1 = 2", "parse_error"), ("then stop", "unknown"), ("x + 1 = 2", "unknown"), ("6 / 0 = 1", "unknown")])
def test_check_equation(spark, step, status):
    assert one(spark, grade.check_equation("t"), t=step) == status


def clean_code_model(code):
    import re

    code = re.sub(r"\n?```$", "", re.sub(r"^```python\n?", "", code))
    kept, level = [], None
    for line in code.split("\n"):
        indent = len(line) - len(line.lstrip())
        if line.strip().startswith("def "):
            if level is None:
                level = indent
            elif indent <= level:
                break
        kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("code", ["", "x = 1", "def f():\n  return 1\n\nx = 2\ndef g():\n  pass", "  def f():\n    def h():\n      pass\ndef g(): pass", "```python\ndef f():\n  pass\n```"])
def test_clean_code(spark, code):
    assert one(spark, grade.clean_code("t"), t=code) == clean_code_model(code)


def test_rewards(spark):
    assert one(spark, grade.partial_credit_reward("t", F.lit("12")), t="#### 12.5") == 0.5
    assert one(spark, grade.partial_credit_reward("t", F.lit("12")), t="the answer is 12") == 1.0
    assert one(spark, grade.grade_strict("t", F.lit("12")), t="I think\nit is 12") is True
    assert one(spark, grade.grade_strict("t", F.lit("12")), t="12 of 13 or so") is False
    assert one(spark, grade.grade_lenient("t", F.lit("1,200")), t="Answer: 1200") is True
    assert one(spark, grade.is_rejected_candidate("t", F.lit("5")), t="#### 6") is True
    assert one(spark, grade.is_rejected_candidate("t", F.lit("5")), t="nothing") is False
