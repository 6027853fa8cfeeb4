"""URL filtering with pattern rules, each indexed by its rarest literal token.

A rule is a host (with all its subdomains) and a path prefix, or a free regular expression with the literal tokens it
needs. Tokens are runs of letters and digits, lower-cased. Rarity is counted over the tokens of all URLs of the table.
A URL's tokens fetch the rules that are indexed under them, and only those rules run their regular expression.
Of the host rules that fit, the longest (host and path together) decides; without one the free patterns decide: block
if any fits, else allow.

Rules are configuration: a list that the caller holds and every task gets. Line feeds and other odd characters in a URL
are characters like any other.

Null URLs and URLs without "://" have an empty host and path; free patterns still see the whole URL. Repeated rows are
judged each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9]+"
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_candidates int"
#: Stands between host and path; a host ends and a path is cut before it, so neither holds it.
BETWEEN = "#"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str
    pattern: str = ""
    literals: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return self.pattern or f"{self.host}{self.path}"

    def expression(self) -> str:
        """Matches host and path with BETWEEN in between, or the whole URL for a free pattern."""
        return self.pattern or rf"(?s)\A(?:.*\.)?{re.escape(self.host)}{BETWEEN}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Tokens every fitting URL has: those of the literals that cannot be the cut end of a longer token."""
        if self.pattern:
            return sorted({t.lower() for x in self.literals for t in re.findall(TOKEN, x)})
        ends = re.findall(TOKEN, self.path)
        if ends and self.path[-1].isalnum():
            ends.pop()
        return sorted({t.lower() for t in [*re.findall(TOKEN, self.host), *ends]})


def host_rules(block: list[str], allow: list[str]) -> list[Rule]:
    """Rules from strings such as "example.net/en/": host up to the first slash, path from there on."""
    out = []
    for verdict, names in (("block", block), ("allow", allow)):
        for name in names:
            host, slash, path = name.partition("/")
            out.append(Rule(host.lower(), slash + path, verdict))
    return out


def free_rule(pattern: str, *literals: str) -> Rule:
    """A blocking pattern; literals are whole tokens that every match has to contain."""
    return Rule("", "", "block", pattern, literals)


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules occurs; the result is as long as the rules have tokens."""
    wanted = sorted({t for rule in rules for t in rule.tokens()})
    counts: dict[str, int] = {}
    for i in range(0, len(wanted), 10_000):
        part = wanted[i : i + 10_000]
        tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(f"({TOKEN})"), F.lit(1)))
        found = pages.select(F.explode(F.filter(tokens, lambda t: t.isin(part))).alias("token")).groupBy("token").count()
        counts |= {r["token"]: r["count"] for r in found.collect()}
    return counts


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their rarest token; under "" those without any, which every URL has to try."""
    index: dict[str, list[int]] = defaultdict(list)
    for i, rule in enumerate(rules):
        index[min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")].append(i)
    return dict(index)


@lru_cache(maxsize=100_000)
def compiled(expression: str) -> re.Pattern:
    """A rule is compiled when it is first fetched; a worker keeps it."""
    return re.compile(expression)


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    lowered = host.translate({c: c + 32 for c in range(65, 91)})
    return lowered, re.split(r"[?#]", rest, maxsplit=1)[0]


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, the deciding host rule or null, verdict, and how many rules ran."""
    index = index_rules(rules, token_counts(pages, rules, url_col))
    shared = pages.sparkSession.sparkContext.broadcast((rules, index))

    def judge(batches):
        own, lookup = shared.value
        word = re.compile(TOKEN)
        for batch in batches:
            out = []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = parts(url)
                joined, best, blocked, ran = f"{host}{BETWEEN}{path}", None, False, 0
                for token in {"", *(t.lower() for t in word.findall(url or ""))}:
                    for i in lookup.get(token, ()):
                        rule, ran = own[i], ran + 1
                        if rule.pattern:
                            blocked = blocked or bool(compiled(rule.pattern).search(url or ""))
                        elif compiled(rule.expression()).match(joined) and (best is None or (len(rule.name), rule.name) > (len(best.name), best.name)):
                            best = rule
                verdict = best.verdict if best else "block" if blocked else "allow"
                out.append((page_id, host, path, best.name if best else None, verdict, ran))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(judge, SCHEMA)
