"""URL filters: a blocked Bloom filter before an exact join with the list.

A list row is a host, a path and a verdict; it covers the host with all its subdomains where the path
starts with its own. A url is looked up under the keys it can match: its host cut to a number of
labels and its path cut to a number of characters, for those pairs of numbers that occur in the list.
The blocked Bloom filter of the listed keys drops nearly all other keys: each key sets its bits in one
block, so the filter is a table of blocks and a lookup is one equi-join on the block number. What it
passes meets the list itself in an exact join, which removes false positives, and the longest row wins.

Urls are first reduced to their distinct hosts and paths, so a url that fills a third of the table is
looked up once. A null url, or one without ``://``, has an empty host and path and no rule fits it.
Copies and equal ids get the same answer on each row; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import filled
from staylens.operators.joins import broadcast_if_small

# The filter's block is eight words of 64 bits; a key sets this many bits, and the
# filter has about this many bits for a key.
WORDS = 8
WORD_BITS = 64
KEY_BITS = 6
BITS_PER_KEY = 16

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(filled(url), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(filled(url), r"://[^/?#]*([^?#]*)", 1)


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def listed(rules: DataFrame) -> DataFrame:
    """The list by its canonical keys: host, path, verdict, n_labels, n_path, and the rule's text.

    The same key listed twice counts once; block beats allow there.
    """
    host = F.translate(filled(F.col("host")), UPPER, UPPER.lower())
    keys = rules.select(
        host.alias("host"), filled(F.col("path")).alias("path"), filled(F.col("verdict")).alias("verdict")
    )
    return (
        keys.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            "host",
            "path",
            "verdict",
            labels_of(F.col("host")).alias("n_labels"),
            F.length("path").alias("n_path"),
            F.concat("host", "path").alias("rule"),
        )
    )


def block_of(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks))


def bits_of(host: Column, path: Column) -> list[Column]:
    """The places, 0 to 511, of a key's bits in its block."""
    spread = F.xxhash64(path, host, F.lit("bits"))
    return [
        F.shiftrightunsigned(spread, 9 * k).bitwiseAND(F.lit(511)).cast("int")
        for k in range(KEY_BITS)
    ]


def word_mask(bits: list[Column], word: int) -> Column:
    """The bits of a key that fall into one word of the block."""
    mask = F.lit(0).cast("long")
    for bit in bits:
        own = F.when(
            F.floor(bit / WORD_BITS) == word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(WORD_BITS)))
        ).otherwise(F.lit(0).cast("long"))
        mask = mask.bitwiseOR(own)
    return mask


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: one row per block that holds a key, with its eight words."""
    bits = bits_of(F.col("host"), F.col("path"))
    return (
        keys.select(
            block_of(F.col("host"), F.col("path"), blocks).alias("block"),
            *[word_mask(bits, w).alias(f"w{w}") for w in range(WORDS)],
        )
        .groupBy("block")
        .agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])
    )


def candidates(urls: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys under which each distinct (host, path) may be listed."""
    shapes = keys.select("n_labels", "n_path").distinct()
    # At most as many shapes as rules; they travel as one array with every url.
    known = shapes.agg(F.collect_set(F.struct("n_labels", "n_path")).alias("shapes")).scalar()
    labels = F.split("host", r"\.")

    def key(shape: Column) -> Column:
        cut = F.slice(labels, F.size(labels) - shape["n_labels"] + 1, shape["n_labels"])
        return F.struct(
            F.array_join(cut, ".").alias("key_host"),
            F.substring("path", F.lit(1), shape["n_path"]).alias("key_path"),
        )

    fitting = F.filter(
        "shapes", lambda s: (s["n_labels"] <= F.size(labels)) & (s["n_path"] <= F.length("path"))
    )
    return urls.withColumn("shapes", known).select(
        "host", "path", F.explode(F.transform(fitting, key)).alias("key")
    ).select("host", "path", "key.*")


def possible_hits(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The candidates that the blocked Bloom filter passes."""
    count = max(1, keys.count())
    blocks = -(-count * BITS_PER_KEY // (WORDS * WORD_BITS))
    filter_blocks = broadcast_if_small(bloom_blocks(keys, blocks))
    bits = bits_of(F.col("key_host"), F.col("key_path"))
    held = F.lit(True)
    for w in range(WORDS):
        mask = word_mask(bits, w)
        held = held & (F.col(f"w{w}").bitwiseAND(mask) == mask)
    return (
        keyed.withColumn("block", block_of(F.col("key_host"), F.col("key_path"), blocks))
        .join(filter_blocks, "block")
        .filter(held)
        .select("host", "path", "key_host", "key_path")
    )


def verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, the longest fitting rule (or null), and the verdict.

    ``rules`` has host, path and verdict. A url that no rule fits gets ``otherwise``. Of fitting
    rules of one length the one with the longer host wins.
    """
    keys = listed(rules)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = parsed.select("host", "path").filter(F.length("host") > 0).distinct()
    hits = possible_hits(candidates(urls, keys), keys)
    exact = keys.select(
        F.col("host").alias("key_host"), F.col("path").alias("key_path"), "rule", "verdict"
    )
    longest = F.max(
        F.struct(F.length("rule"), F.length("key_host"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    )
    found = (
        hits.join(exact, ["key_host", "key_path"])
        .groupBy("host", "path")
        .agg(longest.alias("best"))
        .select("host", "path", "best.rule", F.col("best.verdict").alias("ruled"))
    )
    return parsed.join(found, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.lit(otherwise)).alias("verdict"),
    )
