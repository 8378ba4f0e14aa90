"""One query for each operator of this package, over whole tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.llm import (
    bpe, exact_dedup, fill_middle, fingerprints, mixing, ppm, ranked_search, sanitise, secret_scan, simhash, token_files, toxicity, url_rules)
from landrecon.operators.rounds import Rounds
from landrecon.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(ship(spark), sf_dir)

    QUERIES[run.__name__] = shipped
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to files and what the files give back."""
    folder = Rounds(spark).path()
    token_files.write(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return token_files.positions(spark, folder)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes decoded from them."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document among equal texts."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


ORACLE["op8_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model learned outside fold 0."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SEED, TEMPERATURE = 5, 0.5


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix, in shuffled order."""
    mixed = mixing.mix(documents(spark, sf_dir), SEED, TEMPERATURE)
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.col("_copy").alias("copy"),
                        F.col("_copies").alias("copies"))


ORACLE["op5_mixing"] = ("SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, copies::INT AS copies FROM ("
                        + mixing.MIX_SQL.format(documents="documents", seed=SEED, temperature=TEMPERATURE, epochs=1.0) + ")")


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.edits(documents(spark, sf_dir))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text."""
    return secret_scan.report(documents(spark, sf_dir))


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM scores of every document."""
    return ppm.scores(documents(spark, sf_dir))


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every text made ready for filling in its middle."""
    return fill_middle.digests(documents(spark, sf_dir))


ORACLE["op13_fill_middle"] = fill_middle.SQL


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE["op11_ranked_search"] = ranked_search.SQL


@query
def op12_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of the terms that disclose it."""
    return sanitise.report(documents(spark, sf_dir))
