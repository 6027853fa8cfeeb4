"""Algebraic equality: identities, near-misses and refusals, alone and as a stage of grading."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rollforge.functions import algebra, grade
from rollforge.operators import grading

SAME = [
    ("2*3", "6"), ("x+1", "1+x"), ("2x(y+1)", "2xy+2x"), ("(x+1)^2", "x^2+2x+1"), ("-x^2", "-(x*x)"), ("x^-1", "1/x"), ("2^-1", "0.5"), ("1/2x", "x/2"), ("(x^2-1)/(x-1)", "x+1"), ("--x", "x"), ("x**2", "x*x"),
    ("0.1+0.2", "0.3"), ("2^(3)", "8"), ("1.0000001", "1"), ("a b", "ba"), ("(a+b)(a-b)", "a^2-b^2"), ("3(x)", "x+x+x"), ("x/y/z", "x/(y z)"), ("+x", "x"), (".5x", "x/2"), ("x - -y", "y+x"), ("(((x)))", " x "), ("1/(1/x)", "x"), ("x^0", "1"),
    ("(x-y)^3", "x^3-3x^2y+3xy^2-y^3"), ("2^10", "1024"), ("7-2-1", "4"), ("8/4/2", "1"), ("2*-3", "-6"), ("(2/3)^2", "4/9"),
]
OTHER = [
    ("x+1", "x+2"), ("2*3", "7"), ("x^2", "x"), ("xy", "x+y"), ("(x+1)^2", "x^2+1"), ("-x^2", "(-x)^2"), ("1/x", "x"), ("x-y", "y-x"), ("1.001", "1"), ("x/(2y)", "x/2y"), ("7-(2-1)", "4"), ("x", "y"), ("0", "0.0001"), ("x+1", "1"), ("2^3^1", "9"),
    ("(a+b)^2", "a^2+b^2"), ("x^63", "x^64"), ("a/b+c", "a/(b+c)"),
]
REFUSED = ["sin(x)", "", " ", "3 4", "x^y", "x^0.5", "1/0", ")", "(x", "x+", "*x", "x=1", "abc", "x^65", "3,000", "x!", "1.2.3", "()", "+".join("x" * 500), "x/(y-y)"]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert algebra.same(a, b) is True and algebra.same(b, a) is True


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert algebra.same(a, b) in (False, None) and algebra.same(b, a) is not True


@pytest.mark.parametrize("a", REFUSED)
def test_refused(a):
    assert algebra.same(a, "x+1") is None and algebra.same("x+1", a) is None and algebra.same(None, a) is None


def test_products_of_factors_and_near_misses():
    rng = random.Random(8)
    for _ in range(200):
        roots = [rng.randrange(-9, 10) for _ in range(rng.choice([1, 2, 3, 4]))]
        lead = Fraction(rng.randrange(1, 9), rng.randrange(1, 5))
        poly = [lead]
        for r in roots:  # coefficients from the constant on
            poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
        text = lambda cs: " + ".join(f"({c.numerator}/{c.denominator})*x^{i}" for i, c in enumerate(map(Fraction, cs)))
        factored = f"({lead.numerator}/{lead.denominator})" + "".join(f"(x-{r})" if r >= 0 else f"(x+{-r})" for r in roots)
        assert algebra.same(factored, text(poly)) is True
        poly[rng.randrange(len(poly))] += Fraction(1, rng.choice([1, 7, 1000]))
        assert algebra.same(factored, text(poly)) is False


def test_grading_with_and_without_the_algebraic_stage(spark):
    rows = [("x+1", "1+x"), ("2*3", "6"), ("x+1", "x+2"), ("word", "other word"), (None, "1"), ("The answer is 42", "42"), ("\\boxed{2a+2b}", "2(a+b)"), ("same", "SAME")]
    df = spark.createDataFrame(rows, "p string, e string")
    status = lambda **more: [r.v.status for r in grading.with_math_verdict(df, "p", "e", "v", **more).collect()]
    assert status() == ["incorrect"] * 5 + ["correct", "incorrect", "correct"]
    assert status(algebra=True) == ["correct", "correct", "incorrect", "incorrect", "incorrect", "correct", "correct", "correct"]


def test_equation_steps(spark):
    steps = {"2(x+1) = 2x+2": "correct", "x+1 = x+2": "incorrect", "3*4 = 12": "correct", "no equation": "unknown", "a = b = c": "parse_error", "sin x = 1": "unknown", "2 + 2 = 5": "incorrect", "total = 5": "unknown", None: "unknown"}
    df = spark.createDataFrame([(s,) for s in steps], "step string")
    got = [r.status for r in df.select(grade.check_equation_algebra("step").alias("status")).collect()]
    assert got == list(steps.values())
    assert df.select(F.count_if(grade.check_equation("step") == "correct").alias("n")).first().n == 1
