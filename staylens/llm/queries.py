"""The registered queries of the operators, with SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import chat, filter_audit, mixing, pieces, quality, secrets, simhash, sketches, spelling, sql, token_counts, toxicity, url_filter, warc
from staylens.session import fresh_path

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The weights of the sources, repeating.
SOURCE_WEIGHTS = (5, 2, 1)


@query("op1_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents, with as many words as they hold."""
    taken = mixing.mixed(
        table(spark, folder, "documents"),
        lambda sources: mixing.code_point_weights(sources, SOURCE_WEIGHTS),
    )
    return taken.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "source",
    )


@query("op2_secret_scans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents, by a ledger that starts empty."""
    docs = table(spark, folder, "documents")
    ledger = secrets.update_ledger(docs, secrets.new_ledger(spark))
    found = secrets.findings_by_path(docs, ledger)
    spans = secrets.spans_text(F.col("findings"))
    counts = [
        secrets.count_of("findings", kind).alias(f"n_{kind}") for kind in secrets.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


@query("op3_sentencepiece")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(table(spark, folder, "documents"), path)


# A conversation that holds control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"
ODD_TURNS = [(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)]


@query("op4_chat_formatting")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and an odd one, formatted in windows and read back from them."""
    odd = spark.createDataFrame(ODD_TURNS, "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, folder, "conversations").select(*odd.columns).unionByName(odd)
    return chat.read_back(chat.windows(turns))


# Fixed value: the length of a context.
TOKEN_LIMIT = 2048


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they exceed a context."""
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = token_counts.document_counts(table(spark, folder, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op6_quality_rules", sql.quality_rules())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return quality.judged(table(spark, folder, "documents"))


@query("op7_warc", sql.archives())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back, in the order of the merged index."""
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    index = warc.merged_index(warc.read_captures(spark, path))
    return index.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        "url_key",
        F.unix_seconds("captured_at").alias("captured_at"),
    )


@query("op8_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how near they are."""
    return sketches.beside_next(table(spark, folder, "documents"))


# The rules of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op9_url_filters", sql.url_filters(URL_RULES))
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.verdicts(table(spark, folder, "pages"), rules)


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_filter_audit", sql.filter_audit())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters does at every step of every order, by source."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of all documents, by a machine trained on the labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
