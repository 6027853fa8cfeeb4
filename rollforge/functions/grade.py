"""Answer extraction and grading as columns; but for check_equation_algebra nothing here leaves the JVM.

Patterns use ASCII classes and (?d), so only a line feed ends a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollforge.functions.algebra import same_expression
from rollforge.functions.text import col, strip

# Answer patterns in order of priority, units, number forms, rewrites of answers, and code fences.
ANSWER_CASCADE = [
    r"\\boxed\{([^}]+)\}",
    r"####\s*(.+?)(?:\n|$)",
    r"[Tt]he (?:final )?answer is[:\s]*([^\n.]+)",
    r"[Tt]herefore[,:]?\s*(?:the answer is\s*)?([^\n.]+)",
    r"[Ss]o[,:]?\s*(?:the answer is\s*)?([^\n.]+?)(?:\.|$)",
    r"=\s*([^\n=]+?)(?:\n|$)",
]
GSM8K_NUMBER = r"####\s*(-?[\d,]+(?:\.\d+)?)"
UNITS = r"\s*(dollars?|cents?|percent|%|miles?|hours?|minutes?|seconds?|kg|km|m|cm|mm)\s*$"
NUMBER = r"-?\d+\.?\d*"
STRICT_CASCADE = [
    r"####\s*(-?\d+\.?\d*)",
    r"\\boxed\{(-?\d+\.?\d*)\}",
    r"[Tt]he\s+(?:final\s+)?answer\s+is[:\s]+(-?\d+\.?\d*)",
    r"[Aa]nswer[:\s]+(-?\d+\.?\d*)\s*$",
    r"=\s*(-?\d+\.?\d*)\s*(?:dollars?|cents?|units?)?\s*$",
    r"[Tt]herefore[,:\s]+.*?(-?\d+\.?\d*)\s*$",
    r"[Ss]o[,:\s]+.*?(-?\d+\.?\d*)\s*$",
]
LENIENT_CASCADE = [r"####\s*(-?\d+\.?\d*)", r"\\boxed\{([^}]+)\}", r"answer[:\s]+(-?\d+\.?\d*)", r"=\s*(-?\d+\.?\d*)\s*$"]
CURRENCY, FRACTION, THOUSANDS, COMMAND, BRACES = r"[\$£€]", "\\frac", r"(\d),(\d)", r"\\[a-zA-Z]+", r"[{}]"
LONE_NUMBER = r"(?d)^[^\d]*(-?\d+\.?\d*)[^\d]*$"
CANDIDATE = r"(?d)####\s*(-?\d+\.?\d*)|[Aa]nswer.*?(-?\d+\.?\d*)"
MARKED_ANSWER = r"answer is[:\s]*(-?\d+\.?\d*)"
FENCES = [r"(?s)```{language}\n(.*?)```", r"(?s)```\n(.*?)```", r"(?s)```(.*?)```"]
OPEN_FENCE, CLOSE_FENCE = r"^```python\n?", r"\n?```$"
PLAIN_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def last_hit(c: Column, pattern: str, flags: str = "(?d)") -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(1)), F.lit(-1))


def number(c: Column) -> Column:
    """A plain decimal number, or null; underscores and type suffixes are no numbers."""
    return F.when(c.rlike(PLAIN_FLOAT), c.try_cast("double"))


def _digits(c: Column) -> Column:
    """Nothing but digits, as most ground truths are: no pattern hits or changes such a text."""
    return c.rlike(r"\A[0-9]+\z")


def extract_final_answer(c: Column | str) -> Column:
    """The last hit of the first pattern that hits, without math and text wrappers."""
    found = strip(F.coalesce(*[last_hit(col(c), p) for p in ANSWER_CASCADE]))
    bare = F.regexp_replace(F.regexp_replace(found, r"^\$|\$$", ""), r"^\\text\{|\}$", "")
    return F.when(~_digits(col(c)), bare)


def extract_gsm8k_answer(c: Column | str) -> Column:
    """The first number after ####, without commas; else the general extraction."""
    first = F.nullif(F.regexp_extract(col(c), GSM8K_NUMBER, 1), F.lit(""))
    return F.coalesce(F.replace(first, F.lit(","), F.lit("")), extract_final_answer(c))


def normalize_answer(c: Column | str) -> Column:
    out = F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), CURRENCY, "")
    out = F.replace(F.regexp_replace(out, "(?i)" + UNITS, ""), F.lit(FRACTION), F.lit(""))
    out = F.regexp_replace(out, THOUSANDS, "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, COMMAND, ""), BRACES, "")
    return F.when(_digits(col(c)), col(c)).otherwise(strip(out))


def numeric_of(text: Column) -> Column:
    """The number that a normalised answer stands for: a/b or a plain number; null otherwise and for a zero divisor."""
    parts = F.split(text, "/")
    slashes = F.size(parts) - 1
    ratio = F.try_divide(number(parts[0]), number(F.get(parts, F.lit(1))))
    mixed = r"^(-?\d+)\s+(\d+)/(\d+)"
    piece = lambda i: F.nullif(F.regexp_extract(text, mixed, i), F.lit("")).try_cast("double")
    return F.when(~text.contains("/"), number(text)).when(slashes == 1, ratio).when(slashes > 1, piece(1) + F.try_divide(piece(2), piece(3))).otherwise(number(text))


def same_number(p: Column, e: Column, tolerance: float = 1e-6) -> Column:
    """Relative error under the tolerance; absolute where 0 is expected. False if either is null."""
    return F.coalesce(F.when(e == 0, F.abs(p) < tolerance).otherwise(F.try_divide(F.abs(p - e), F.abs(e)) < tolerance), F.lit(False))


def closeness(p: Column, e: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(p - e) / F.greatest(F.abs(e), F.lit(1.0))), F.lit(0.0))


def truth_number(c: Column | str) -> Column:
    """The last number of the ground truth, as text."""
    return F.try_element_at(F.regexp_extract_all(F.regexp_replace(col(c), r"[,$]", ""), F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))


def _without_signs(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[,$]", "")


def grade_strict(response: Column | str, truth: Column | str) -> Column:
    """Some explicit pattern's last number, or a lone number on the last line, within 0.01."""
    text, want = _without_signs(response), truth_number(F.regexp_replace(col(truth), " ", "")).try_cast("double")
    near = [F.abs(last_hit(text, p, "(?dim)").try_cast("double") - want) < 0.01 for p in STRICT_CASCADE]
    line = strip(F.try_element_at(F.split(strip(text), "\n"), F.lit(-1)))
    lone = F.nullif(F.regexp_extract(line, LONE_NUMBER, 1), F.lit(""))
    near.append(F.abs(lone.try_cast("double") - want) < 0.01)
    return reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in near])


def grade_lenient(response: Column | str, truth: Column | str) -> Column:
    """The first pattern's last hit, else the last number anywhere; equal as numbers, else as text without case."""
    text = col(response)
    found = strip(F.coalesce(*[last_hit(text, p, "(?di)") for p in LENIENT_CASCADE]))
    found = F.coalesce(found, last_hit(text, f"({NUMBER})"))
    want = F.coalesce(truth_number(truth), strip(_without_signs(truth)))
    p, e = number(found), number(want)
    same = F.when(p.isNotNull() & e.isNotNull(), F.abs(p - e) < 1e-6).otherwise(F.lower(found) == F.lower(want))
    return F.coalesce(same, F.lit(False))


def extract_marked_number(response: Column | str) -> Column:
    """The last number after ####, else after "answer is"."""
    return F.coalesce(last_hit(col(response), STRICT_CASCADE[0]), last_hit(F.lower(col(response)), MARKED_ANSWER))


def grade_extracted(response: Column | str, truth: Column | str) -> Column:
    """Equal as text: the marked number and the last number of the truth."""
    want = F.try_element_at(F.regexp_extract_all(F.replace(col(truth), F.lit(","), F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1))
    return F.coalesce(extract_marked_number(response) == want, F.lit(False))


def partial_credit_reward(response: Column | str, truth: Column | str) -> Column:
    """1 within 0.01, 0.5 within 1; the first pattern that earns credit decides."""
    text, want = _without_signs(response), truth_number(truth).try_cast("double")
    gaps = [F.abs(last_hit(text, p, "(?dim)").try_cast("double") - want) for p in STRICT_CASCADE[:5]]
    return F.coalesce(*[F.when(g < 0.01, 1.0).when(g < 1.0, 0.5) for g in gaps], F.lit(0.0))


def is_rejected_candidate(response: Column | str, truth: Column | str) -> Column:
    """Whether the last number after #### or "answer" differs from the truth by more than 0.01."""
    pattern = F.lit(CANDIDATE)
    hits = F.arrays_zip(F.regexp_extract_all(col(response), pattern, F.lit(1)).alias("a"), F.regexp_extract_all(col(response), pattern, F.lit(2)).alias("b"))
    said = F.try_element_at(F.transform(hits, lambda h: F.coalesce(F.nullif(h["a"], F.lit("")), h["b"])), F.lit(-1))
    return F.coalesce(F.abs(said.try_cast("double") - truth_number(truth).try_cast("double")) > 0.01, F.lit(False))


def check_equation(step: Column | str) -> Column:
    """Status of "a op b = c": no sign unknown, several parse_error, numbers compared; other algebra unknown."""
    parts = F.split(col(step), "=")
    left, right = strip(parts[0]), strip(F.get(parts, F.lit(1)))
    form = r"^(-?\d+\.?\d*)\s*([-+*/])\s*(-?\d+\.?\d*)$"
    x, op, y = (F.regexp_extract(left, form, i) for i in (1, 2, 3))
    x, y, want = x.try_cast("double"), y.try_cast("double"), number(right)
    value = F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(op == "/", F.try_divide(x, y)).otherwise(number(left))
    judged = F.when(F.abs(value - want) < 1e-9, "correct").when(value.isNotNull() & want.isNotNull(), "incorrect").otherwise("unknown")
    return F.when(F.size(parts) == 1, "unknown").when(F.size(parts) > 2, "parse_error").otherwise(judged)


def check_equation_algebra(step: Column | str) -> Column:
    """check_equation, with the two sides of other equations compared as expressions; what is none stays unknown."""
    plain, parts = check_equation(step), F.split(col(step), "=")
    same = same_expression(strip(parts[0]), strip(F.get(parts, F.lit(1))), (plain == "unknown") & (F.size(parts) == 2))
    return F.when(same, "correct").when(~same, "incorrect").otherwise(plain)


def extract_code(c: Column | str, language: str = "python") -> Column:
    """The first fenced block: with the language's tag, bare, or any; else the whole text."""
    hits = [F.try_element_at(F.regexp_extract_all(col(c), F.lit(p.replace("{language}", language)), F.lit(1)), F.lit(1)) for p in FENCES]
    return strip(F.coalesce(*hits, col(c)))


def clean_code(c: Column | str) -> Column:
    """Without fences, and up to the next function on the first function's level."""
    bare = F.regexp_replace(F.regexp_replace(col(c), OPEN_FENCE, ""), CLOSE_FENCE, "")
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
    begins = lambda x: F.startswith(strip(x), F.lit("def "))
    start = F.struct(F.lit(-1).alias("level"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        inside = state["level"] >= 0
        over = state["over"] | (inside & begins(x) & (indent(x) <= state["level"]))
        level = F.when(~inside & begins(x), indent(x)).otherwise(state["level"])
        return F.struct(level.alias("level"), over.alias("over"), F.when(over, state["kept"]).otherwise(F.concat(state["kept"], F.array(x))).alias("kept"))

    return F.array_join(F.aggregate(F.split(bare, "\n"), start, step)["kept"], "\n")


def assemble_test_program(code: Column | str, tests: Column | str, entry_point: Column | str) -> Column:
    return F.concat(col(code), F.lit("\n\n"), col(tests), F.lit("\n\ncheck("), col(entry_point), F.lit(")"))


def call_program(code: Column | str, call: Column | str, language: str = "python") -> Column:
    if language == "python":
        return F.concat(F.lit("\n"), col(code), F.lit("\n\nresult = "), col(call), F.lit("\nprint(result)\n"))
    if language == "javascript":
        return F.concat(F.lit("\n"), col(code), F.lit("\n\nconsole.log("), col(call), F.lit(");\n"))
    raise ValueError(f"no call wrapper for {language}")


def execution_status(exit_code: Column | str, seconds: Column | str, compiled: Column | str, limit: float) -> Column:
    """The status of a recorded run."""
    return F.when(~col(compiled), "compilation_error").when(col(seconds) > limit, "timeout").when(col(exit_code) == 0, "success").otherwise("runtime_error")
