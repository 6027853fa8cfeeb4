"""Cleaning queries over documents read as responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollforge.functions import text as tx
from rollforge.operators import clean
from rollforge.operators.ordinals import numbered
from rollforge.plans.derived import ANSWERS, answers
from rollforge.plans.grading import sql_strip
from rollforge.plans.registry import query
from rollforge.sources.scratch import written

KEY = ["problem_id", "sample_idx"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers with step and answer markers, artifacts and wide blanks in three of four rows."""
    kind = F.col("sample_idx") % 4
    text = F.col("reasoning")
    marked = (
        F.when(kind == 0, F.concat(F.lit("Step 1: read. Step 2: write.\n\n\n\n"), text, F.lit("\n#### 42")))
        .when(kind == 1, F.concat(F.lit("First,  we   look. We can then go on. "), text, F.lit(" Therefore the answer is 7")))
        .when(kind == 2, F.concat(F.lit("Assistant: $$  x $$ <|end|> "), text))
        .otherwise(text)
    )
    return answers(spark, sf_dir).withColumn("reasoning", marked)


SAMPLES = f"""{ANSWERS}, samples AS (SELECT * REPLACE (CASE sample_idx % 4 WHEN 0 THEN 'Step 1: read. Step 2: write.' || chr(10) || chr(10) || chr(10) || chr(10) || reasoning || chr(10) || '#### 42'
  WHEN 1 THEN 'First,  we   look. We can then go on. ' || reasoning || ' Therefore the answer is 7' WHEN 2 THEN 'Assistant: $$  x $$ <|end|> ' || reasoning ELSE reasoning END AS reasoning) FROM answers)"""


def _sql_normal(x: str) -> str:
    out = sql_strip(f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")
    out = f"regexp_replace(regexp_replace({out}, '\\$\\$\\s*', '$$', 'g'), '\\s*\\$\\$', '$$', 'g')"
    out = f"regexp_replace({out}, '(?i)^(Assistant:|AI:|Response:)\\s*', '')"
    return f"regexp_replace(regexp_replace({out}, '<\\|.*?\\|>', '', 'g'), '(?s)\\[INST\\].*?\\[/INST\\]', '', 'g')"


def _sql_hits(x: str, patterns: list[str], flags: str) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " + ".join(f"len(regexp_extract_all({x}, '{flags}{p}'))" for p in quoted) + ")"


_WORDS = "list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda w: w <> '')"
_ANY = " OR ".join(f"regexp_matches(t, '(?im){p}')" for p in tx.ANSWER_MARKERS)
_SENT = f"list_transform(list_filter(list_transform(regexp_split_to_array(t, '[.!?\\n]'), lambda s: {sql_strip('s')}), lambda s: length(s) > 20), lambda s: lower(s))"
FACTS = f"""{SAMPLES}, n AS (SELECT *, {_sql_normal('reasoning')} AS t FROM samples), f0 AS (SELECT *, {_sql_hits('t', tx.STEP_MARKERS, '(?i)')} AS steps, ({_ANY}) AS has_answer, {_WORDS} AS words, {_SENT} AS sents FROM n),
  f1 AS (SELECT *, list_transform(range(1, greatest(len(words) - 5, 0) + 1), lambda i: array_to_string(words[i:i+4], ' ')) AS grams FROM f0),
  f AS (SELECT *, CASE WHEN len(sents) < 3 THEN false WHEN len(list_distinct(sents)) / len(sents) < 0.7 THEN true WHEN len(words) < 20 THEN false ELSE len(grams) > 0 AND len(list_distinct(grams)) / nullif(len(grams), 0) < 0.5 END AS rep,
        CASE WHEN length(t) < 100 THEN 'too_short' WHEN length(t) > 8000 THEN 'too_long' WHEN len(words) < 50 THEN 'too_few_tokens' WHEN len(words) > 2048 THEN 'too_many_tokens' END AS length_reason FROM f1),
  marked AS (SELECT *, CASE WHEN steps < 2 THEN 'no_steps' WHEN NOT has_answer THEN 'no_answer' WHEN rep THEN 'repetitive' END AS quality_reason FROM f)"""


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("reasoning", tx.normalize_reasoning("reasoning"))


@query(f"WITH {SAMPLES} SELECT problem_id, sample_idx, {_sql_normal('reasoning')} AS reasoning FROM samples")
def normalize_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select(*KEY, "reasoning")


@query(f"WITH {FACTS} SELECT problem_id, sample_idx, quality_reason AS reject_reason FROM marked WHERE quality_reason IS NOT NULL")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _normal(spark, sf_dir).withColumn("reject_reason", clean.quality_reason("reasoning", clean.Config()))
    return marked.where("reject_reason is not null").select(*KEY, "reject_reason")


@query(f"WITH {FACTS} SELECT problem_id, sample_idx, rep AS is_repetitive FROM f")
def is_repetitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select(*KEY, tx.is_repetitive("reasoning").alias("is_repetitive"))


@query(f"WITH {FACTS} SELECT problem_id, sample_idx, length_reason AS reject_reason FROM f WHERE length_reason IS NOT NULL")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _normal(spark, sf_dir).withColumn("reject_reason", clean.length_reason("reasoning", clean.Config()))
    return marked.where("reject_reason is not null").select(*KEY, "reject_reason")


@query(f"WITH {FACTS} SELECT coalesce(quality_reason, length_reason, 'kept') AS reason, count(*) AS n FROM marked GROUP BY 1")
def preprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.reason_stats(clean.with_reasons(samples(spark, sf_dir)))


def sql_fold(rows: str) -> str:
    """CTEs fold and kept (problem_id, sample_idx): the pass in order over rows (problem_id, sample_idx, confidence, s), one row of each problem a round."""
    both = "len(list_intersect(k.s, w.s))"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY sample_idx) AS i FROM {rows}),
  fold AS (SELECT DISTINCT problem_id, 0::BIGINT AS i, []::STRUCT(idx BIGINT, conf DOUBLE, s VARCHAR[])[] AS held FROM o UNION ALL
    SELECT problem_id, i, CASE WHEN hit IS NULL THEN list_append(held, me) WHEN me.conf > hit.conf THEN list_append(list_filter(held, lambda k: k.idx <> hit.idx), me) ELSE held END
    FROM (SELECT f.problem_id, w.i, held, struct_pack(idx := w.sample_idx, conf := w.confidence, s := w.s) AS me,
                 list_filter(held, lambda k: len(k.s) > 0 AND len(w.s) > 0 AND {both} / (len(k.s) + len(w.s) - {both}) > 0.85)[1] AS hit
          FROM fold f JOIN o w ON w.problem_id = f.problem_id AND w.i = f.i + 1)),
  kept AS (SELECT problem_id, unnest(held).idx AS sample_idx FROM fold JOIN (SELECT problem_id, max(i) AS i FROM fold GROUP BY 1) USING (problem_id, i))"""


CLEANED = f"{FACTS}, passed AS (SELECT problem_id, sample_idx, is_correct, confidence, problem, t, list_distinct(words) AS s FROM marked WHERE quality_reason IS NULL AND length_reason IS NULL), {sql_fold('passed')}, cleaned AS (SELECT p.* FROM passed p JOIN kept USING (problem_id, sample_idx))"
SMART_OF_CLEANED = """cj AS (SELECT c.problem_id, c.sample_idx AS c_idx, r.sample_idx AS r_idx, c.confidence AS cc, r.confidence AS rc, c.problem AS prompt, c.t AS chosen, r.t AS rejected,
    CASE WHEN len(c.s) = 0 OR len(r.s) = 0 THEN 1 ELSE 1 - len(list_intersect(c.s, r.s)) / (len(c.s) + len(r.s) - len(list_intersect(c.s, r.s))) END AS d FROM cleaned c JOIN cleaned r ON c.problem_id = r.problem_id AND c.is_correct AND NOT r.is_correct),
  csmart AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY d DESC, cc DESC, c_idx, rc DESC, r_idx) AS rank FROM cj WHERE d >= 0.2) WHERE rank <= 5)"""


@query(f"WITH RECURSIVE {CLEANED} SELECT problem_id, sample_idx, t AS reasoning FROM cleaned")
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain."""
    return clean.preprocess(samples(spark, sf_dir)).select(*KEY, "reasoning")


_SETS = f"{ANSWERS}, w AS (SELECT problem_id, sample_idx, list_distinct(list_filter(regexp_split_to_array(lower(reasoning), '\\s+'), lambda x: x <> '')) AS s FROM answers)"
_JAC = "len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"


@query(f"WITH RECURSIVE {_SETS.replace('sample_idx, list_distinct', 'sample_idx, confidence, list_distinct')}, {sql_fold('w')} SELECT problem_id, sample_idx FROM kept")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedup_greedy(answers(spark, sf_dir)).select(*KEY)


@query(f"WITH {_SETS} SELECT a.problem_id, a.sample_idx AS a_idx, b.sample_idx AS b_idx, round({_JAC}, 6) AS similarity FROM w a JOIN w b ON a.problem_id = b.problem_id AND a.sample_idx < b.sample_idx WHERE len(a.s) > 0 AND len(b.s) > 0 AND {_JAC} > 0.85")
def near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.near_duplicates(answers(spark, sf_dir)).select("problem_id", "a_idx", "b_idx", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {ANSWERS}, o AS (SELECT *, lead(reasoning) OVER (PARTITION BY problem_id ORDER BY sample_idx) AS other FROM answers), s AS (SELECT problem_id, sample_idx, list_distinct(list_filter(regexp_split_to_array(lower(reasoning), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(other), '\\s+'), lambda x: x <> '')) AS b FROM o WHERE other IS NOT NULL) SELECT problem_id, sample_idx, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END::DOUBLE, 6) AS jaccard, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 1 - len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END::DOUBLE, 6) AS diversity FROM s")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response against the next one of its problem. Ids are numbered; word sets meet by id, not in a group's order."""
    sets = answers(spark, sf_dir).select(*KEY, tx.word_set("reasoning").alias("words"))
    placed = written(numbered(answers(spark, sf_dir).select(*KEY), ["problem_id"], ["sample_idx"]), "placed")
    after = placed.select(F.col("problem_id").alias("p"), (F.col("place") - 1).alias("before"), F.col("sample_idx").alias("next_idx"))
    pairs = placed.hint("merge").join(after.hint("merge"), (F.col("problem_id") == F.col("p")) & (F.col("place") == F.col("before"))).select(*KEY, "next_idx")
    side = lambda name, idx: sets.select(F.col("sample_idx").alias(idx), F.col("words").alias(name)).hint("merge")
    base = pairs.hint("merge").join(side("a", "sample_idx"), "sample_idx").hint("merge").join(side("b", "next_idx"), "next_idx")
    return base.select(*KEY, F.round(tx.jaccard_of(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(tx.diversity_of(F.col("a"), F.col("b"), 0.0), 6).alias("diversity"))


@query(f"WITH {_SETS} SELECT a.problem_id, a.sample_idx AS a_idx, b.sample_idx AS b_idx, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE 1 - {_JAC.replace('/ (', '/ nullif(')[:-1]}, 0) END::DOUBLE, 6) AS raw_diversity, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 1 ELSE 1 - {_JAC.replace('/ (', '/ nullif(')[:-1]}, 0) END::DOUBLE, 6) AS ranked_diversity FROM w a JOIN w b ON a.problem_id = b.problem_id AND b.sample_idx = a.sample_idx + 20")
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two responses of a problem: texts without words differ by 0 among raw pairs and by 1 among ranked ones."""
    base = answers(spark, sf_dir).select(*KEY, tx.word_set("reasoning").alias("s"))
    a, b = base.select("problem_id", F.col("sample_idx").alias("a_idx"), F.col("s").alias("a")), base.select("problem_id", F.col("sample_idx").alias("b_idx"), F.col("s").alias("b"))
    met = a.hint("merge").join(b.withColumn("before", F.col("b_idx") - 20).hint("merge"), (F.col("a_idx") == F.col("before")) & (a.problem_id == b.problem_id)).drop(b.problem_id)
    return met.select("problem_id", "a_idx", "b_idx", F.round(tx.diversity_of(F.col("a"), F.col("b"), 0.0), 6).alias("raw_diversity"), F.round(tx.diversity_of(F.col("a"), F.col("b"), 1.0), 6).alias("ranked_diversity"))


@query(f"WITH {FACTS} SELECT problem_id, sample_idx, len(list_distinct(sents)) AS sentences, len(list_distinct(grams)) AS grams, len(list_distinct(string_split(t, chr(10))[1:4])) AS first_lines FROM f")
def distinct_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = tx.let(tx.words("reasoning"), lambda tokens: tx.ngrams(tokens, 5, drop_last=True))
    lines = F.slice(F.split("reasoning", "\n"), 1, 4)
    return _normal(spark, sf_dir).select(*KEY, F.size(F.array_distinct(tx.sentences("reasoning"))).cast("long").alias("sentences"), F.size(F.array_distinct(grams)).cast("long").alias("grams"), F.size(F.array_distinct(lines)).cast("long").alias("first_lines"))


@query("SELECT d.doc_id AS problem_id, coalesce(lang, source, '') AS kind, coalesce(text, '') AS reasoning, coalesce(source, lang, '') AS prompt FROM documents d")
def coalesce_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("text", "response")
    named = clean.coalesce_fields(docs, {"reasoning": ["reasoning", "response"], "prompt": ["prompt", "source"], "kind": ["kind", "lang"]})
    return named.select(F.col("doc_id").alias("problem_id"), "kind", "reasoning", "prompt")


@query(f"WITH {ANSWERS} SELECT is_correct, count(*) AS n, sum(length(reasoning))::BIGINT AS chars FROM answers GROUP BY 1")
def split_by_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both partitions are filters of one scan; here with their sizes."""
    rows = answers(spark, sf_dir)
    sized = lambda df, flag: df.agg(F.count("*").alias("n"), F.sum(F.length("reasoning")).alias("chars")).select(F.lit(flag).alias("is_correct"), "n", "chars")
    return sized(rows.where("is_correct"), True).unionByName(sized(rows.where("not is_correct"), False))


@query("SELECT l_orderkey AS problem_idx, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def difficulty_subject_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality predicates on two columns, which the scan takes over."""
    from rollforge.sources.readers import difficulty_subject

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnsRenamed({"l_returnflag": "level", "l_linestatus": "type"})
    return difficulty_subject(items, "R", "F").select(F.col("l_orderkey").alias("problem_idx"), "l_linenumber", "l_quantity")
