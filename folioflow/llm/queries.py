"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import pyarrow  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equals."""
    from folioflow.llm.exact import exact_duplicates

    found = exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    from folioflow.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a passage with another, with the words to remove."""
    from folioflow.llm.passages import repeated_passages

    words = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "component_id", words("spans").alias("repeated_words"), words("remove").alias("removed_words"), F.to_json("spans").alias("spans"), F.to_json("remove").alias("remove"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of labels outside one fifth."""
    from folioflow.llm.ngram import fold_of
    from folioflow.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels").filter(fold_of() != 0))
    return score(docs, model).select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a list as of its fetch.

    The tables have neither fetch dates nor a list, so both follow from rules: a
    page's day from its id, and a site's entries (listed, taken off, listed
    again) from the MD5 of its name.
    """
    from folioflow.llm.urlfilter import evaluate, host_of

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    captures = pages.withColumn("fetched_on", day((F.col("page_id") * 37 % 365).cast("int")))
    sites = pages.select(F.regexp_replace(host_of(F.col("url")), r"^(www|blog|m)\.", "").alias("key")).dropna().distinct()
    sites = sites.withColumn("n", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")).filter("n % 4 != 0")
    first = F.col("n") % 250
    entries = sites.select(
        "key",
        F.when(F.col("n") % 3 == 0, "malware").when(F.col("n") % 3 == 1, "spam").otherwise("adult").alias("category"),
        F.explode(F.array(
            F.struct(day(first).alias("effective"), F.lit("add").alias("action")),
            F.struct(F.when(F.col("n") % 2 == 0, day(first + 40 + F.col("n") % 50)).alias("effective"), F.lit("remove").alias("action")),
            F.struct(F.when(F.col("n") % 8 == 2, day(first + 110)).alias("effective"), F.lit("add").alias("action")),
        )).alias("e"),
    ).select("key", "category", "e.effective", "e.action")
    found = evaluate(captures, entries)
    return found.select("page_id", "url", F.col("fetched_on").cast("string").alias("fetched_on"), "blocked", "block_categories", F.col("blocked_since").cast("string").alias("blocked_since"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a model of four fifths of them."""
    from folioflow.llm.ngram import fold_of, score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.filter(fold_of() != 1))
    found = score(docs, model)
    return found.select("doc_id", (fold_of() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    from folioflow.llm.decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and what they decode to, as digests."""
    import public_tokenizers as P

    from folioflow.llm.bpe import encode, read_ranks

    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return encode(_table(spark, sf_dir, "documents"), ranks, P.PATTERN, with_ids=False)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    from folioflow.llm.wrappers import main_text

    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the token files give it back."""
    import public_tokenizers as P

    from folioflow.llm.tokenfile import read_digests, write_tokens

    return read_digests(write_tokens(_table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), end=2))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_decontamination": op8_decontamination,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
    "op6_url_filter": r"""
        WITH p AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS d,
                   nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '.'), '') AS host
            FROM pages
        ), s AS (
            SELECT DISTINCT regexp_replace(host, '^(www|blog|m)[.]', '') AS site FROM p WHERE host IS NOT NULL
        ), n AS (
            SELECT site, CAST('0x' || substr(md5(site), 1, 6) AS INTEGER) AS n FROM s
        ), e AS (
            SELECT site, n, CASE n % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'spam' ELSE 'adult' END AS category,
                   DATE '2024-01-01' + n % 250 AS a1,
                   CASE WHEN n % 2 = 0 THEN DATE '2024-01-01' + (n % 250 + 40 + n % 50) END AS r1,
                   CASE WHEN n % 8 = 2 THEN DATE '2024-01-01' + (n % 250 + 110) END AS a2
            FROM n WHERE n % 4 <> 0
        ), i AS (
            SELECT site, category, a1 AS f, r1 AS t FROM e
            UNION ALL
            SELECT site, category, a2, NULL FROM e WHERE a2 IS NOT NULL AND r1 < a2
        )
        SELECT page_id, url, CAST(d AS VARCHAR) AS fetched_on, count(i.f) > 0 AS blocked,
               coalesce(string_agg(DISTINCT i.category, ',' ORDER BY i.category), '') AS block_categories,
               CAST(min(i.f) AS VARCHAR) AS blocked_since
        FROM p LEFT JOIN i ON (p.host = i.site OR ends_with(p.host, '.' || i.site)) AND i.f <= p.d AND (i.t IS NULL OR p.d < i.t)
        GROUP BY page_id, url, d
    """,
}
