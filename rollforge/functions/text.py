"""Text as columns: words, n-grams, similarity, normalisation, step and answer markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker patterns that define a reasoning step and an answer, and the rewrites that normalise a text.
STEP_MARKERS = [r"step\s*\d+", r"\d+\)", r"\d+\.", r"first|second|third|then|next|finally", r"let's|we can|we need|we have"]
ANSWER_MARKERS = [r"(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)", r"therefore|thus|so|hence", r"=\s*[\d.]+\s*$", r"\\boxed\{", r"####"]
#: How every hit of a marker begins: looked for before its many alternatives are.
BEGINS = {STEP_MARKERS[3]: "[fstn]", STEP_MARKERS[4]: "[lw]", ANSWER_MARKERS[1]: "[tsh]"}
NEWLINES, SPACES, AFTER_MATH, BEFORE_MATH = r"\n{3,}", r" {2,}", r"\$\$\s*", r"\s*\$\$"
SPEAKER, SPECIAL, INSTRUCTION = r"(?i)^(Assistant:|AI:|Response:)\s*", r"(?d)<\|.*?\|>", r"(?s)\[INST\].*?\[/INST\]"
EVAL_STEP_MARKERS = [r"step\s*\d+", r"^\d+\.", r"first|second|third|then|next|finally"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without the white space that a pattern's \\s means at both ends."""
    return F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))


def words(c: Column | str) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != "")


def word_set(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def ngrams(tokens: Column, n: int, drop_last: bool = False) -> Column:
    """Joined n-grams; drop_last leaves out the final one.

    Shifted copies of the array are zipped: a lambda that cuts each n-gram out would compute the array anew each time.
    """
    count = F.greatest(F.size(tokens) - (n if drop_last else n - 1), F.lit(0))
    shifted = [F.slice(tokens, F.lit(i + 1), count) for i in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), shifted)


def jaccard_of(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 when either is empty. The words in both are counted once."""
    share = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard_of(word_set(a), word_set(b))


def diversity_of(a: Column, b: Column, empty: float) -> Column:
    """1 - Jaccard; the value for empty texts differs between raw pairs (0) and ranked pairs (1)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(1 - jaccard_of(a, b))


def normalize_reasoning(c: Column | str, whitespace: bool = True, math: bool = True, artifacts: bool = True) -> Column:
    out = col(c)
    if whitespace:
        out = _where("\n\n\n", out, lambda x: F.regexp_replace(x, NEWLINES, "\n\n"))
        out = strip(_where("  ", out, lambda x: F.regexp_replace(x, SPACES, " ")))
    if math:
        out = _where("$$", out, lambda x: F.regexp_replace(F.regexp_replace(x, AFTER_MATH, r"\$\$"), BEFORE_MATH, r"\$\$"))
    if artifacts:
        out = F.regexp_replace(out, SPEAKER, "")
        out = _where("<|", out, lambda x: F.regexp_replace(x, SPECIAL, ""))
        out = _where("[INST]", out, lambda x: F.regexp_replace(x, INSTRUCTION, ""))
    return out


def _where(sign: str, value: Column, use) -> Column:
    """use(value) for texts that hold the sign, which every hit of use's pattern does; others stay as they are."""
    return let(value, lambda x: F.when(x.contains(sign), use(x)).otherwise(x))


def count_hits(c: Column | str, patterns: list[str], flags: str) -> Column:
    return reduce(Column.__add__, [F.regexp_count(col(c), F.lit(flags + p)) for p in patterns])


def _quick(pattern: str) -> str:
    return f"(?={BEGINS[pattern]})(?:{pattern})" if pattern in BEGINS else pattern


def step_count(c: Column | str) -> Column:
    return count_hits(c, STEP_MARKERS, "(?i)")


def has_steps(c: Column | str, least: int) -> Column:
    """Whether step_count is at least that; markers are counted one after the other, and no further than it takes."""

    def more(found: Column, patterns: list[str]) -> Column:
        if not patterns:
            return found >= least
        return F.when(found >= least, True).otherwise(let(found + F.regexp_count(col(c), F.lit("(?i)" + _quick(patterns[0]))), lambda n: more(n, patterns[1:])))

    return more(F.lit(0), STEP_MARKERS)


def has_answer(c: Column | str) -> Column:
    return reduce(Column.__or__, [col(c).rlike("(?dim)" + _quick(p)) for p in sorted(ANSWER_MARKERS, key=len)])


def has_answer_marker(c: Column | str) -> Column:
    """The short form that search methods use: #### or "answer is"."""
    return col(c).contains("####") | F.lower(col(c)).contains("answer is")


def eval_step_count(c: Column | str) -> Column:
    """Marker hits, or half the line breaks if those are more."""
    breaks = F.regexp_count(col(c), F.lit("\n"))
    return F.greatest(count_hits(c, EVAL_STEP_MARKERS, "(?dim)"), F.floor(breaks / 2).cast("int"))


def sentences(c: Column | str) -> Column:
    """Lower-cased sentences of more than 20 characters."""
    return F.transform(F.filter(F.transform(F.split(col(c), r"[.!?\n]"), strip), lambda s: F.length(s) > 20), F.lower)


def gram_hashes(tokens: Column, n: int, drop_last: bool = False) -> Column:
    """64-bit hashes of the n-grams, for counting distinct ones without building their texts."""
    count = F.greatest(F.size(tokens) - (n if drop_last else n - 1), F.lit(0))
    shifted = [F.slice(tokens, F.lit(i + 1), count).alias(f"w{i}") for i in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda gram: F.xxhash64(gram))


def is_repetitive(c: Column | str, max_ratio: float = 0.3, tokens: Column | None = None) -> Column:
    """Few distinct sentences, or few distinct 5-grams; texts of fewer than 3 long sentences never are. tokens: the text's words, where they are at hand.

    5-grams are counted by 64-bit hashes, and only where the sentences do not decide. There are at least as many distinct
    ones as first words and first pairs of words, so those are counted before; most texts have enough of them.
    """

    def echo(tokens: Column) -> Column:
        n = F.size(tokens) - 5
        first = F.size(F.array_distinct(F.slice(tokens, F.lit(1), n)))
        two = F.size(F.array_distinct(F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda x, y: F.xxhash64(x, y))))
        five = F.size(F.array_distinct(gram_hashes(tokens, 5, drop_last=True)))
        return F.when(F.size(tokens) < 20, False).when(first * 2 >= n, False).when(two * 2 >= n, False).otherwise(five * 2 < n)

    def judge(found: Column) -> Column:
        few = F.size(F.array_distinct(found)) / F.nullif(F.size(found), F.lit(0)) < 1 - max_ratio
        return F.when(F.size(found) < 3, False).when(few, True).otherwise(F.coalesce(let(words(c) if tokens is None else tokens, echo), F.lit(False)))

    return let(sentences(c), judge)


def path_hash(problem_id: Column | str, reasoning: Column | str) -> Column:
    return F.substring(F.md5(F.concat_ws(":", col(problem_id), col(reasoning))), 1, 16)
