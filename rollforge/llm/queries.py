"""One query for each operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollforge.llm import chat, decontaminate, exact, hyperlang, ngram_join, packing, quality, rollup, stripes, toxicity, trie, urls, warc

RULES = urls.host_rules(block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
FREE = [urls.free_rule(r"(?i)://(?:[^/?#]*\.)?spam-farm\.", "spam", "farm"), urls.free_rule(r"(?i)[/.-]casino[/.-]", "casino")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rolled_up(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES + FREE).select("page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hyperlang.identify(docs, hyperlang.train(docs))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": op3_ngram_join,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_url_filters": op5_url_filters,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_id": op12_language_id,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op4_chat_formatting": chat.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op13_collocations": stripes.ORACLE,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url FROM pages),
        u AS (SELECT *, lower(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE url END) AS rest FROM p),
        k AS (SELECT *, array_to_string(list_reverse(string_split(split_part(split_part(rest, '/', 1), ':', 1), '.')), ',') || ')' || CASE WHEN instr(rest, '/') > 0 THEN split_part(substr(rest, instr(rest, '/')), '#', 1) ELSE '' END AS url_key,
                     strftime(make_timestamp((page_id + 1577836800) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at, min(page_id) OVER (PARTITION BY html) AS first_id FROM u)
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to, url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position FROM k""",
    "op5_url_filters": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f AS (SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, url ORDER BY length(rh || rp) DESC) AS n, url
              FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT q.page_id, q.host, q.path, f.rule,
               coalesce(f.rv, CASE WHEN regexp_matches(q.url, '(?i)://([^/?#]*\\.)?spam-farm\\.') OR regexp_matches(q.url, '(?i)[/.-]casino[/.-]') THEN 'block' ELSE 'allow' END) AS verdict
        FROM q LEFT JOIN f ON f.page_id = q.page_id AND f.url = q.url AND f.n = 1""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
