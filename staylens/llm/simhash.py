"""SimHash near-duplicates found through Golay-code keys.

A document's fingerprint has a bit set where over half the hashes of its three-word shingles have it.
Fingerprints of at most two differing bits are linked, and a component is what links connect.

A fingerprint is cut into three segments of 22, 21 and 21 bits. Of two differing bits at least one
segment holds none, so linked fingerprints have an equal segment; the others hold two at most. The
words of the (23, 12) Golay code lie so that each word of 23 bits has exactly one of them within three
bits. The keys of a segment are the indices of the codewords to which it and its neighbours at one bit
decode, about six of them. Two segments that differ in two bits have a common neighbour, hence a common
key. A fingerprint is therefore filed under each (equal segment, key of the next segment), about
eighteen places, and every linked pair meets in one of them; pairs that meet are verified.

A place with more than ``BUCKET`` fingerprints gives no pairs. Its fingerprints are filed under
themselves and their 64 neighbours instead: two fingerprints differ in two bits or fewer exactly if they
share such a place, and each links to the least one there. That is linear, so nothing is capped or lost.

Equal fingerprints are one from the start, so copies never meet as pairs. Tables are written to the
shared folder between rounds; only counts come to the driver.

A null text is the empty text; an empty one has fingerprint zero and links like any other. Copies and
equal ids keep their rows. Null ids are passed over when the smallest id of a component is taken. Only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import row_key, unused
from staylens.session import staged

# Fixed values of the fingerprint.
SHINGLE = 3
SEED = 42
DISTANCE = 2

# First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

# The generator of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
CODE_BITS = 23
CHECK_BITS = 11

# Fingerprints in one place that are compared with each other.
BUCKET = 64

# Shingles whose bits are counted at once.
BATCH = 65_536


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, count, BATCH):
        high = min(count, low + BATCH)
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED)
            for i in range(low, high)
        ]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > count).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter(
            (fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts)
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"]
        )


def fingerprints(ids: Column, text: Column, docs: DataFrame) -> DataFrame:
    """Per row: ``id`` and ``fp``, the fingerprint as a signed 64-bit number."""
    rows = docs.select(ids.alias("id"), text.cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"id {kind}, fp bigint")


def shown(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- Golay code


def _remainder(word: int) -> int:
    for place in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        if word >> place & 1:
            word ^= GENERATOR << (place - CHECK_BITS)
    return word


def _error_table() -> np.ndarray:
    """For each remainder, the one error of at most three bits that leaves it."""
    single = [_remainder(1 << i) for i in range(CODE_BITS)]
    table = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for i in range(CODE_BITS):
        table[single[i]] = 1 << i
        for j in range(i):
            table[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                table[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return table


class Golay:
    """Decodes arrays of 23-bit words to the index of the nearest codeword."""

    def __init__(self) -> None:
        self.errors = _error_table()
        low = range(1 << 12)
        self.low = np.array([_remainder(x) for x in low], dtype=np.int64)
        self.high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)

    def index(self, words: np.ndarray) -> np.ndarray:
        remainder = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.errors[remainder]) >> CHECK_BITS

    def keys(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words and of their neighbours, with a mask that drops repeats."""
        flips = np.array([0, *(1 << i for i in range(bits))], dtype=np.int64)
        found = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        fresh = np.ones(found.shape, dtype=bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        return found, fresh


def places(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Every (place, position of the fingerprint) under which unsigned fingerprints are filed."""
    cut = [
        ((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        for at, bits in SEGMENTS
    ]
    all_places, owners = [], []
    for equal in range(len(SEGMENTS)):
        near = (equal + 1) % len(SEGMENTS)
        keys, fresh = golay.keys(cut[near], SEGMENTS[near][1])
        filed = (equal << 40) | (cut[equal][:, None] << 12) | keys
        owner = np.broadcast_to(np.arange(len(fps))[:, None], keys.shape)
        all_places.append(filed[fresh])
        owners.append(owner[fresh])
    return np.concatenate(all_places), np.concatenate(owners)


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        for low in range(0, batch.num_rows, 8192):
            fps = batch.column(0).slice(low, 8192).to_numpy(zero_copy_only=False)
            filed, owner = places(fps.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays(
                [pa.array(filed), pa.array(fps[owner])], names=["place", "fp"]
            )


# -- links


def links(distinct: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Links (fp, lower) that connect exactly the fingerprints that links of two bits connect.

    ``distinct`` has one row per fingerprint, column ``fp``, and is a written table.
    """
    if distance > 2:
        raise ValueError("the keys find fingerprints of at most two differing bits")
    filed = distinct.select("fp").mapInArrow(_place_batches, "place bigint, fp bigint")
    sizes = filed.groupBy("place").agg(F.count("*").alias("size")).filter("size > 1")
    met = staged(filed.join(sizes, "place"), "simhash-met")

    def near(one: Column, other: Column) -> Column:
        return F.bit_count(one.bitwiseXOR(other)) <= distance

    def pairs(fps: Column) -> Column:
        rows = F.transform(
            fps,
            lambda x, i: F.transform(
                F.filter(F.slice(fps, i + 2, bucket), lambda y: near(x, y)),
                lambda y: F.struct(y.alias("fp"), x.alias("lower")),
            ),
        )
        return F.flatten(rows)

    few = (
        met.filter(F.col("size") <= bucket)
        .groupBy("place")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.inline(pairs(F.col("fps"))))
    )
    return few.unionByName(crowded_links(met.filter(F.col("size") > bucket), distance)).distinct()


def crowded_links(met: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints that stand in a crowded place, through shared neighbours."""
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
    )
    own = F.array("fp")
    around = own if distance == 0 else F.concat(own, flips)
    spread = met.select("fp").distinct().select("fp", F.explode(around).alias("place"))
    least = spread.groupBy("place").agg(F.min("fp").alias("lower"), F.count("*").alias("size"))
    found = spread.join(least.filter("size > 1"), "place").filter("fp > lower")
    if distance == 1:
        found = found.filter(F.bit_count(F.col("fp").bitwiseXOR("lower")) <= 1)
    return found.select("fp", "lower")


# -- components


def components(edges: DataFrame) -> DataFrame:
    """Per node that has a link: ``node`` and ``root``, the least node it is connected with.

    Alternating large-star and small-star rounds; each round's links are written to the shared
    folder. ``edges`` has two columns of numbers.
    """
    high, low = edges.columns
    current = staged(
        edges.select(F.greatest(high, low).alias("u"), F.least(high, low).alias("v"))
        .filter("u > v")
        .distinct(),
        "components",
    )
    seen = None
    while True:
        mark = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
        ).first()
        if mark == seen:
            break
        seen = mark
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # Large star: the greater neighbours of a node move to its least neighbour.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: a node and its lesser neighbours move to the least of them.
        low_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low_of, "u").select(
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            )
        )
        current = staged(small.filter("u > v").distinct(), "components")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def groups(prints: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Per distinct fingerprint: ``fp``, ``group_id`` (the least id of its component).

    ``prints`` has ``id`` and ``fp`` and is a written table.
    """
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-distinct")
    roots = components(links(distinct, bucket, distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("group_id"))
    return rooted.join(least, "root").select("fp", "group_id")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    bucket: int = BUCKET,
    distance: int = DISTANCE,
) -> DataFrame:
    """Per row: the id, the fingerprint and the smallest id that links reach from it."""
    prints = staged(fingerprints(F.col(id_column), F.col(text), docs), "simhash-prints")
    found = groups(prints, bucket, distance)
    return prints.join(found, "fp").select(
        F.col("id").alias(id_column),
        shown(F.col("fp")).alias("fingerprint"),
        F.col("group_id").alias("component_id"),
    )


def one_per_group(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    bucket: int = BUCKET,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row of each group that ``near_duplicates`` finds, with its own columns: that of the smallest id.

    Of rows with the same id the one with the least digest of the whole row stays, rows that are equal stay once;
    null ids give way to others.
    """
    order = F.struct(F.col(id_column).isNull(), F.col(id_column), row_key(docs))
    prints = staged(fingerprints(order, F.col(text), docs), "simhash-prints")
    wanted, key = unused(docs, "wanted"), unused(docs, "key")
    found = groups(prints, bucket, distance)
    stay = found.select(F.col("group_id.col3").alias(wanted)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, row_key(docs))
    held = keyed.join(stay, F.col(key) == F.col(wanted), "left_semi")
    return held.dropDuplicates([key]).select(*columns)
