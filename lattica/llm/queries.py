"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, html_extract, minhash, mixing, pii, quality, secrets, tokens, urls
from ._shared import load

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED = ("ads-track.example.org", "casino-win.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org")
BYTE_RANKS, WORD_TOKENIZER = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(load(spark, sf_dir, "pages"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(load(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(load(spark, sf_dir, "documents"))
    counts = [_count("base", k) for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_store(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(load(spark, sf_dir, "documents"))
    rows = mix.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in BLOCKED])).alias("key"))
    return urls.url_filter(load(spark, sf_dir, "pages"), RULES, blocked)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op8_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(load(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "anomaly", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    counts = [_count("secrets", k) for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_order_minhash, op3_pii, op4_token_store, op5_mixing, op6_url_filter, op7_byte_bpe, op8_near_embeddings, op9_quality_rules, op10_secret_scan)}

_URL_RULES = ", ".join(f"('{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{k}', '{v}')" for k, v in RULES)
_BLOCKED = ", ".join(f"('{x}')" for x in BLOCKED)

ORACLE_SQL = {
    "op6_url_filter": f"""
        with rules(h, p, rule, verdict) as (values {_URL_RULES}), blocked(b) as (values {_BLOCKED}),
        parsed as (select page_id,
            translate(case when strpos(coalesce(url, ''), '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            case when strpos(coalesce(url, ''), '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path, row_number() over () as rn from pages),
        best as (select rn, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from parsed join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rn)
        select page_id, host, path, rule, coalesce(verdict, case when exists (select 1 from blocked where host = b or ends_with(host, '.' || b)) then 'block' else 'allow' end) as verdict
        from parsed left join best using (rn)""",
    "op9_quality_rules": None,
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
