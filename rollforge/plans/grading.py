"""Extraction and grading queries over rollouts, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.functions import grade
from rollforge.functions.text import has_answer_marker, path_hash
from rollforge.operators import grading
from rollforge.operators.evals import judge_tests
from rollforge.plans.derived import CHATS, ROLLOUTS, chats, read, rollouts
from rollforge.plans.registry import query

KEY = ["problem_id", "sample_idx"]
_END = r"(?:\n|\n?\z)"


def _last(text: str, pattern: str, flags: str = "") -> str:
    """The last hit of a pattern, as DuckDB writes it; $ there does not match before a final line feed."""
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all({text}, '{flags}{quoted}', 1)[-1]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_final(x: str) -> str:
    patterns = [p.replace(r"(?:\n|$)", _END).replace(r"(?:\.|$)", r"(?:\.|\n?\z)") for p in grade.ANSWER_CASCADE]
    found = sql_strip("coalesce(" + ", ".join(_last(x, p) for p in patterns) + ")")
    return f"regexp_replace(regexp_replace({found}, '^\\$|\\$$', '', 'g'), '^\\\\text\\{{|\\}}$', '', 'g')"


def sql_gsm8k(x: str) -> str:
    return f"coalesce(replace(nullif(regexp_extract({x}, '{grade.GSM8K_NUMBER}', 1), ''), ',', ''), {sql_final(x)})"


def sql_number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{grade.PLAIN_FLOAT}') THEN try_cast({sql_strip(x)} AS DOUBLE) END"


def sql_normal(x: str) -> str:
    out = f"regexp_replace({sql_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '[\\$£€]', '', 'g')"
    out = f"replace(regexp_replace({out}, '(?i){grade.UNITS}', '', 'g'), '\\frac', '')"
    out = f"regexp_replace({out}, '(\\d),(\\d)', '\\1\\2', 'g')"
    return sql_strip(f"regexp_replace(regexp_replace({out}, '\\\\[a-zA-Z]+', '', 'g'), '[{{}}]', '', 'g')")


def sql_truth(x: str) -> str:
    return f"regexp_extract_all(regexp_replace({x}, '[,$]', '', 'g'), '({grade.NUMBER})', 1)[-1]"


_ENDS = lambda p: p.replace(r"\s*$", r"\s*$")


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, {sql_final('reasoning')} AS answer FROM rollouts")
def extract_final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.extract_final_answer("reasoning").alias("answer"))


@query(f"WITH {CHATS} SELECT conv_id, turn, {sql_final('response')} AS answer FROM chats")
def extract_final_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", "turn", grade.extract_final_answer("response").alias("answer"))


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, {sql_gsm8k('reasoning')} AS answer FROM rollouts")
def extract_gsm8k_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.extract_gsm8k_answer("reasoning").alias("answer"))


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, {sql_normal('reasoning')} AS normal FROM rollouts")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.normalize_answer("reasoning").alias("normal"))


_FORMS = "CASE l_linenumber % 5 WHEN 0 THEN l_partkey || '/' || l_suppkey WHEN 1 THEN '$' || l_quantity::BIGINT || ',500' WHEN 2 THEN '3 1/2' WHEN 3 THEN (l_quantity::BIGINT)::VARCHAR || ' miles' ELSE l_partkey || '/0' END"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities written as fractions, money, mixed numbers, lengths and divisions by zero."""
    items = read(spark, sf_dir, "lineitem")
    q, p, s, kind = F.col("l_quantity").cast("long").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 5
    form = F.when(kind == 0, F.concat(p, F.lit("/"), s)).when(kind == 1, F.concat(F.lit("$"), q, F.lit(",500"))).when(kind == 2, "3 1/2").when(kind == 3, F.concat(q, F.lit(" miles"))).otherwise(F.concat(p, F.lit("/0")))
    return items.select("l_orderkey", "l_linenumber", form.alias("form"), q.alias("expected"))


def _sql_numeric(x: str) -> str:
    n = sql_normal(x)
    return f"CASE WHEN contains({n}, '/') THEN {sql_number(f'split_part({n}, {chr(39)}/{chr(39)}, 1)')} / nullif({sql_number(f'split_part({n}, {chr(39)}/{chr(39)}, 2)')}, 0) ELSE {sql_number(n)} END"


@query(f"WITH f AS (SELECT l_orderkey, l_linenumber, {_FORMS} AS form FROM lineitem) SELECT l_orderkey, l_linenumber, form, round({_sql_numeric('form')}, 6) AS value FROM f")
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.with_numeric(_forms(spark, sf_dir), "form", "value").select("l_orderkey", "l_linenumber", "form", F.round("value", 6).alias("value"))


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, {_FORMS} AS form, l_quantity::BIGINT::VARCHAR AS expected FROM lineitem), n AS (SELECT *, {_sql_numeric('form')} AS p, {_sql_numeric('expected')} AS e FROM f),
    x AS (SELECT *, coalesce(CASE WHEN e = 0 THEN abs(p) < 1e-6 ELSE abs(p - e) / abs(e) < 1e-6 END, false) AS is_equal FROM n)
    SELECT l_orderkey, l_linenumber, form, is_equal, round(CASE WHEN is_equal THEN 1 WHEN p IS NULL OR e IS NULL THEN 0 ELSE greatest(0, 1 - abs(p - e) / greatest(abs(e), 1)) END::DOUBLE, 6) AS closeness FROM x""")
def compare_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = grading.with_number_comparison(_forms(spark, sf_dir), "form", "expected")
    return judged.select("l_orderkey", "l_linenumber", "form", "is_equal", F.round("closeness", 6).alias("closeness"))


def _sql_math(p: str, e: str) -> str:
    """CTEs g (pn, en) and m (status) of graded rollouts; p may be null."""
    both = lambda x: sql_normal(f"coalesce(nullif({sql_final(x)}, ''), {x})")
    return f"""g AS (SELECT *, {both(p)} AS pn, {both(e)} AS en FROM a), h AS (SELECT *, {_sql_numeric('pn')} AS pv, {_sql_numeric('en')} AS ev FROM g),
      m AS (SELECT *, lower(pn) = lower(en) OR coalesce(CASE WHEN ev = 0 THEN abs(pv) < 1e-6 ELSE abs(pv - ev) / abs(ev) < 1e-6 END, false) AS ok FROM h)"""


@query(f"WITH {ROLLOUTS}, a AS (SELECT problem_id, sample_idx, reasoning AS p, expected AS e FROM rollouts), {_sql_math('p', 'e')} SELECT problem_id, sample_idx, CASE WHEN ok THEN 'correct' ELSE 'incorrect' END AS status, en AS expected, pn AS predicted, CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM m")
def grade_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.with_math_verdict(rollouts(spark, sf_dir), "reasoning", "expected", "v").select(*KEY, "v.*")


@query(f"""WITH {ROLLOUTS}, a AS (SELECT problem_id, sample_idx, {sql_final('reasoning')} AS p, expected AS e FROM rollouts), {_sql_math('p', 'e')}
    SELECT problem_id, sample_idx, CASE WHEN p IS NULL THEN 'parse_error' WHEN ok THEN 'correct' ELSE 'incorrect' END AS status, CASE WHEN p IS NULL THEN e ELSE en END AS expected, CASE WHEN p IS NOT NULL THEN pn END AS predicted, CASE WHEN p IS NULL OR ok THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM m""")
def grade_math_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.with_math_path_verdict(rollouts(spark, sf_dir), "reasoning", "expected", "v").select(*KEY, "v.*")


def sql_graded(text: str = "reasoning", truth: str = "expected") -> str:
    """CTE graded: rollouts with their gsm8k verdict."""
    num = lambda x: sql_number(f"replace(coalesce(nullif({sql_gsm8k(x)}, ''), {x}), ',', '')")
    return f"""g0 AS (SELECT *, {num(text)} AS pv, {num(truth)} AS ev FROM rollouts),
      graded AS (SELECT *, CASE WHEN pv IS NULL OR ev IS NULL THEN 'parse_error' WHEN abs(pv - ev) < 0.001 THEN 'correct' ELSE 'incorrect' END AS status, coalesce(abs(pv - ev) < 0.001, false) AS is_correct FROM g0)"""


GRADED = f"{ROLLOUTS}, {sql_graded()}"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with verdict columns status, is_correct, verification_confidence and final_answer."""
    return grading.verify_batch(rollouts(spark, sf_dir))


@query(f"WITH {GRADED} SELECT problem_id, sample_idx, status, ev AS expected, pv AS predicted, CASE WHEN status = 'incorrect' THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM graded")
def grade_gsm8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.with_gsm8k_verdict(rollouts(spark, sf_dir), "reasoning", "expected", "v").select(*KEY, "v.*")


@query(f"WITH {GRADED} SELECT problem_id, sample_idx, is_correct, CASE WHEN status = 'incorrect' THEN 0.0 ELSE 1.0 END::DOUBLE AS verification_confidence, pv AS final_answer, status FROM graded")
def verify_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select(*KEY, "is_correct", "verification_confidence", "final_answer", "status")


_NEAR = lambda x, d: f"coalesce(abs(try_cast({x} AS DOUBLE) - w) < {d}, false)"
_STRICT = " OR ".join(_NEAR(_last("t", p, "(?im)"), 0.01) for p in grade.STRICT_CASCADE)
_LONE = f"nullif(regexp_extract({sql_strip(f'string_split({sql_strip(chr(116))}, chr(10))[-1]')}, '^[^\\d]*(-?\\d+\\.?\\d*)[^\\d]*$', 1), '')"


@query(f"WITH {ROLLOUTS}, t0 AS (SELECT problem_id, sample_idx, regexp_replace(reasoning, '[,$]', '', 'g') AS t, try_cast({sql_truth('expected')} AS DOUBLE) AS w FROM rollouts) SELECT problem_id, sample_idx, {_STRICT} OR {_NEAR(_LONE, 0.01)} AS is_correct FROM t0")
def grade_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.grade_strict("reasoning", "expected").alias("is_correct"))


_LENIENT = ", ".join(_last("reasoning", p.replace(r"\s*$", r"\s*\z"), "(?i)") for p in grade.LENIENT_CASCADE)


@query(f"""WITH {ROLLOUTS}, f AS (SELECT *, coalesce({sql_strip(f'coalesce({_LENIENT})')}, {_last('reasoning', '(' + grade.NUMBER + ')')}) AS f, coalesce({sql_truth('expected')}, expected) AS w FROM rollouts),
    n AS (SELECT *, {sql_number('f')} AS p, {sql_number('w')} AS e FROM f) SELECT problem_id, sample_idx, coalesce(CASE WHEN p IS NOT NULL AND e IS NOT NULL THEN abs(p - e) < 1e-6 ELSE lower(f) = lower(w) END, false) AS is_correct FROM n""")
def grade_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.grade_lenient("reasoning", "expected").alias("is_correct"))


_MARKED = f"coalesce({_last('reasoning', grade.STRICT_CASCADE[0])}, regexp_extract_all(lower(reasoning), 'answer is[:\\s]*(-?\\d+\\.?\\d*)', 1)[-1])"


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, {_MARKED} AS answer, coalesce({_MARKED} = {sql_truth('expected')}, false) AS is_correct FROM rollouts")
def grade_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.extract_marked_number("reasoning").alias("answer"), grade.grade_extracted("reasoning", "expected").alias("is_correct"))


_GAPS = ", ".join(f"CASE WHEN abs(try_cast({_last('t', p, '(?im)')} AS DOUBLE) - w) < 0.01 THEN 1.0 WHEN abs(try_cast({_last('t', p, '(?im)')} AS DOUBLE) - w) < 1.0 THEN 0.5 END" for p in grade.STRICT_CASCADE[:5])
SQL_REWARDS = f"rewards AS (SELECT *, coalesce({_GAPS}, 0.0)::DOUBLE AS reward FROM (SELECT *, regexp_replace(reasoning, '[,$]', '', 'g') AS t, try_cast({sql_truth('expected')} AS DOUBLE) AS w FROM rollouts))"


@query(f"WITH {ROLLOUTS}, {SQL_REWARDS} SELECT problem_id, sample_idx, reward FROM rewards")
def partial_credit_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.partial_credit_reward("reasoning", "expected").alias("reward"))


_CAND = r"####\s*(-?\d+\.?\d*)|[Aa]nswer.*?(-?\d+\.?\d*)"


@query(f"""WITH {ROLLOUTS}, s AS (SELECT *, coalesce(nullif(regexp_extract_all(reasoning, '{_CAND}', 1)[-1], ''), regexp_extract_all(reasoning, '{_CAND}', 2)[-1]) AS said FROM rollouts)
    SELECT problem_id, sample_idx, coalesce(abs(try_cast(said AS DOUBLE) - try_cast({sql_truth('expected')} AS DOUBLE)) > 0.01, false) AS rejected FROM s""")
def is_rejected_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, grade.is_rejected_candidate("reasoning", "expected").alias("rejected"))


@query(f"""WITH {ROLLOUTS}, l AS (SELECT problem_id, sample_idx, unnest(string_split(reasoning, chr(10))) AS step, generate_subscripts(string_split(reasoning, chr(10)), 1) - 1 AS step_no FROM rollouts),
    p AS (SELECT *, string_split(step, '=') AS parts, {sql_strip("string_split(step, '=')[1]")} AS lhs, {sql_number(sql_strip("coalesce(string_split(step, '=')[2], '')"))} AS want FROM l),
    v AS (SELECT *, try_cast(regexp_extract(lhs, '^(-?\\d+\\.?\\d*)\\s*([-+*/])\\s*(-?\\d+\\.?\\d*)$', 1) AS DOUBLE) AS x, regexp_extract(lhs, '^(-?\\d+\\.?\\d*)\\s*([-+*/])\\s*(-?\\d+\\.?\\d*)$', 2) AS op, try_cast(regexp_extract(lhs, '^(-?\\d+\\.?\\d*)\\s*([-+*/])\\s*(-?\\d+\\.?\\d*)$', 3) AS DOUBLE) AS y FROM p),
    r AS (SELECT *, CASE op WHEN '+' THEN x + y WHEN '-' THEN x - y WHEN '*' THEN x * y WHEN '/' THEN x / nullif(y, 0) ELSE {sql_number('lhs')} END AS value FROM v)
    SELECT problem_id, sample_idx, step_no, CASE WHEN len(parts) = 1 THEN 'unknown' WHEN len(parts) > 2 THEN 'parse_error' WHEN abs(value - want) < 1e-9 THEN 'correct' WHEN value IS NOT NULL AND want IS NOT NULL THEN 'incorrect' ELSE 'unknown' END AS status FROM r""")
def check_equation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rollouts(spark, sf_dir).select(*KEY, F.posexplode(F.split("reasoning", "\n")).alias("step_no", "step"))
    return lines.select(*KEY, "step_no", grade.check_equation("step").alias("status"))


_KIND = "l_linenumber % 5"
_SAID = "CASE l_linenumber % 5 WHEN 0 THEN q || '*(x+' || l_linenumber || ')' WHEN 1 THEN q || '*(x+' || l_linenumber || ')' WHEN 2 THEN '(x+' || q || ')^2' WHEN 3 THEN q || '*' || l_linenumber ELSE 'sin(x)+' || q END"
_MEANT = "CASE l_linenumber % 5 WHEN 0 THEN q || 'x+' || (q * l_linenumber) WHEN 1 THEN q || 'x+' || (q * l_linenumber + 1) WHEN 2 THEN 'x^2+' || (2 * q) || 'x+' || (q * q) WHEN 3 THEN '' || (q * l_linenumber) ELSE q || '+sin(x)' END"


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as algebra: expanded, expanded wrongly, a square, a product, and what is no expression."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return items.select("l_orderkey", "l_linenumber", F.expr(_SAID).alias("said"), F.expr(_MEANT).alias("meant"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_KIND} IN (0, 2, 3) THEN 'correct' ELSE 'incorrect' END AS status, {_SAID} AS predicted, {_MEANT} AS expected FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)")
def grade_math_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict with its algebraic stage."""
    return grading.with_math_verdict(_expressions(spark, sf_dir), "said", "meant", "v", algebra=True).select("l_orderkey", "l_linenumber", "v.status", "v.predicted", "v.expected")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_KIND} IN (0, 2, 3) THEN 'correct' WHEN {_KIND} = 1 THEN 'incorrect' ELSE 'unknown' END AS status FROM lineitem")
def check_equation_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _expressions(spark, sf_dir).withColumn("step", F.concat_ws(" = ", "said", "meant"))
    return steps.select("l_orderkey", "l_linenumber", grade.check_equation_algebra("step").alias("status"))


def _answers_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' replies as code, in the fences that models write."""
    said = chats(spark, sf_dir)
    body = F.concat(F.lit("def f(x):\n    return "), F.length("response").cast("string"), F.lit("\n\nx = 1\ndef g():\n    pass\n"))
    kind = F.col("conv_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("Here:\n```python\n"), body, F.lit("```\nDone"))).when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Use ```x = 2``` or ```y```"))).otherwise(body)
    return said.select("conv_id", "turn", text.alias("reply"))


_BODY = "'def f(x):' || chr(10) || '    return ' || length(response) || chr(10) || chr(10) || 'x = 1' || chr(10) || 'def g():' || chr(10) || '    pass' || chr(10)"
CODE = f"""{CHATS}, code AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || {_BODY} || '```' || chr(10) || 'Done' WHEN 1 THEN '```' || chr(10) || {_BODY} || chr(10) || '```'
    WHEN 2 THEN 'Use ```x = 2``` or ```y```' ELSE {_BODY} END AS reply FROM chats)"""
_CODE_OUT = sql_strip("coalesce(regexp_extract_all(reply, '(?s)```python\\n(.*?)```', 1)[1], regexp_extract_all(reply, '(?s)```\\n(.*?)```', 1)[1], regexp_extract_all(reply, '(?s)```(.*?)```', 1)[1], reply)")


@query(f"WITH {CODE} SELECT conv_id, turn, {_CODE_OUT} AS code FROM code")
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers_in_code(spark, sf_dir).select("conv_id", "turn", grade.extract_code("reply").alias("code"))


@query(f"WITH {CODE} SELECT conv_id, turn, CASE WHEN contains({_CODE_OUT}, 'def g') THEN split_part({_CODE_OUT}, chr(10) || 'def g', 1) ELSE {_CODE_OUT} END AS code FROM code")
def clean_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers_in_code(spark, sf_dir).select("conv_id", "turn", grade.clean_code(grade.extract_code("reply")).alias("code"))


@query(f"WITH {CODE} SELECT conv_id, turn, {_CODE_OUT} || chr(10) || chr(10) || 'def check(f):' || chr(10) || '    assert f(1)' || chr(10) || chr(10) || 'check(f)' AS program, chr(10) || {_CODE_OUT} || chr(10) || chr(10) || 'result = f(1)' || chr(10) || 'print(result)' || chr(10) AS call FROM code")
def assemble_test_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = grade.extract_code("reply")
    return _answers_in_code(spark, sf_dir).select("conv_id", "turn", grade.assemble_test_program(code, F.lit("def check(f):\n    assert f(1)"), F.lit("f")).alias("program"), grade.call_program(code, F.lit("f(1)")).alias("call"))


RUNS = "runs AS (SELECT l_orderkey AS task_id, l_linenumber AS test_id, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_quantity::BIGINT || chr(10) END AS stdout, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS exit_code, l_discount * 100 AS seconds, l_linestatus = 'O' AS is_hidden, l_quantity::BIGINT::VARCHAR AS expected_output, l_tax < 0.08 AS compiled FROM lineitem)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded executions: one row per task and test."""
    q = F.col("l_quantity").cast("long").cast("string")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("test_id"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(q, F.lit("\n"))).alias("stdout"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("exit_code"), (F.col("l_discount") * 100).alias("seconds"), (F.col("l_linestatus") == "O").alias("is_hidden"), q.alias("expected_output"), (F.col("l_tax") < 0.08).alias("compiled"),
    )


@query(f"WITH {RUNS} SELECT CASE WHEN NOT compiled THEN 'compilation_error' WHEN seconds > 8 THEN 'timeout' WHEN exit_code = 0 THEN 'success' ELSE 'runtime_error' END AS status, count(*) AS n FROM runs GROUP BY 1")
def execution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy(grade.execution_status("exit_code", "seconds", "compiled", 8.0).alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {RUNS} SELECT task_id, CASE WHEN bool_and({sql_strip('stdout')} = expected_output) THEN 'success' ELSE 'wrong_answer' END AS status, count(*) AS tests, count_if({sql_strip('stdout')} = expected_output) AS passed, count_if(is_hidden) AS hidden FROM runs GROUP BY task_id""")
def test_case_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_tests(runs(spark, sf_dir)).select("task_id", "status", "tests", "passed", "hidden")


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, substr(md5(problem_id || ':' || reasoning), 1, 16) AS path_hash FROM rollouts", name="path_hash")
def path_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, path_hash("problem_id", "reasoning").alias("path_hash"))


@query(f"WITH {ROLLOUTS} SELECT problem_id, sample_idx, contains(reasoning, '####') OR contains(lower(reasoning), 'answer is') AS has_marker FROM rollouts", name="has_answer_marker")
def answer_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select(*KEY, has_answer_marker("reasoning").alias("has_marker"))
