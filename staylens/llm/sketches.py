"""Document fingerprints: bottom-k sketches of shingle hashes.

The sketch of a text is the ``k`` smallest distinct hashes of its five-word shingles, ascending. The sketch
of a union is the ``k`` smallest of two sketches together, so parts can be sketched apart and merged. The
share of common hashes among the ``k`` smallest of a union estimates resemblance; a sketch alone estimates
how many distinct shingles there are, and both together containment. Sketches shorter than ``k`` hold all
hashes, and estimates are then exact.

A null text is the empty text, which has no shingle; a text of fewer than five words has one, all its
words. Two empty sketches resemble each other wholly, an empty and another not at all. Equal texts have
equal sketches. Extra columns of any name are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import filled, shuffle_partitions

SHINGLE = 5
K = 128

# Shingles hashed at once, and words whose hashes a worker remembers.
BATCH = 65_536
WORDS = 200_000
WORD_BYTES = 64

# Odd 64-bit constants of the mixing step.
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_word_hashes: dict[bytes, int] = {}


def _hash_of(words: list[bytes]) -> np.ndarray:
    known = _word_hashes
    if len(known) >= WORDS:
        known.clear()
    for word in set(words).difference(known):
        if len(word) <= WORD_BYTES:
            known[word] = xxhash.xxh64_intdigest(word)
    found = [known.get(w) for w in words]
    for i, value in enumerate(found) if None in found else ():
        if value is None:
            found[i] = xxhash.xxh64_intdigest(words[i])
    return np.array(found, dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * MIX[0]
    values = (values ^ (values >> np.uint64(27))) * MIX[1]
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each run of five words, or one for all words if they are fewer."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes, length = _hash_of(words), min(SHINGLE, len(words))
    count = len(words) - length + 1
    total = np.full(count, length, dtype=np.uint64)
    for k in range(length):
        total = _mixed(total * MULTIPLY + hashes[k : k + count])
    return total


def merged(one: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([one, other]))[:k]


def sketch(text: bytes, k: int = K) -> np.ndarray:
    """The sketch of a text in UTF-8; long texts in overlapping parts that are merged."""
    words = text.split()
    found = np.empty(0, dtype=np.uint64)
    for low in range(0, max(1, len(words) - SHINGLE + 1), BATCH):
        hashes = shingle_hashes(words[low : low + BATCH + SHINGLE - 1])
        found = merged(found, np.unique(hashes)[:k], k)
    return found


def resemblance(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """The estimated share of common shingles in all shingles of both."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    union = merged(one, other, k)
    common = np.intersect1d(one, other, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).sum() / len(union))


def distinct_shingles(sketched: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles."""
    if len(sketched) < k:
        return float(len(sketched))
    return (k - 1) / ((float(sketched[-1]) + 1) / 2.0**64)


def containment(part: np.ndarray, whole: np.ndarray, k: int = K) -> float:
    """The estimated share of the shingles of ``part`` that ``whole`` has."""
    if not len(part):
        return 1.0
    alike, size = resemblance(part, whole, k), distinct_shingles(part, k)
    common = alike * (size + distinct_shingles(whole, k)) / (1 + alike)
    return min(1.0, common / size)


def shown(sketched: np.ndarray) -> str:
    """Sixteen hexadecimal digits for each hash."""
    return sketched.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def sketched(docs: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Per row: the id, ``fingerprint`` and ``n_shingles`` (estimated distinct)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [sketch(t.as_py() or b"", k) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([shown(s) for s in found], pa.string()),
                    pa.array([distinct_shingles(s, k) for s in found], pa.float64()),
                ],
                names=["id", "fingerprint", "n_shingles"],
            )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(
        batches, f"id {kind}, fingerprint string, n_shingles double"
    ).withColumnRenamed("id", id_column)


def merged_by(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """Merge the sketches of parts: per key the sketch of all its parts.

    Repeated hashes meet in the map tasks, and each task passes on k hashes per key, so a key with a
    third of all parts is as cheap as any.
    """
    digits = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("fingerprint") / 16).cast("int") - 1),
        lambda i: F.substring("fingerprint", i * 16 + 1, F.lit(16)),
    )
    hashes = F.when(F.length("fingerprint") > 0, digits).otherwise(F.array().cast("array<string>"))
    rows = parts.select(F.col(key).alias("key"), F.explode_outer(hashes).alias("hash")).distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("hash").asc_nulls_last()))
    return (
        rows.withColumn("place", place)
        .filter(F.col("place") <= k)
        .groupBy("key")
        .agg(F.array_join(F.sort_array(F.collect_list("hash")), "").alias("fingerprint"))
        .withColumnRenamed("key", key)
    )


# -- a document, its edited text and the next document


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    size = len(text) // 4
    return text[: len(text) - size] + following[:size] if size else text


# What is told of a document beside the next one.
PAIR = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
    "n_shingles": pa.float64(),
    "contained_in_edited": pa.float64(),
}
PAIR_TYPES = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles double, contained_in_edited double"
)

# Runs of neighbouring ids for each partition, and rows handed on at once.
RUNS = 4
ROWS = 512


def _compared(text: str, own: np.ndarray, following: str, after: np.ndarray, k: int) -> tuple:
    changed = edited(text, following).encode()
    other = own if changed == text.encode() else sketch(changed, k)
    return (
        len(text),
        hashlib.sha256(changed).hexdigest(),
        shown(own),
        shown(other),
        resemblance(own, other, k),
        resemblance(own, after, k),
        distinct_shingles(own, k),
        containment(own, other, k),
    )


def _numbered(docs: DataFrame, id_column: str, text: str, runs: int) -> DataFrame:
    """``run``, ``id`` and ``text``: runs of neighbouring ids, in order; only balance hangs on the cuts."""
    ids = docs.select(F.col(id_column).cast("double").alias("id"))
    shares = [i / runs for i in range(1, runs)]
    cuts = np.array(sorted(set(ids.approxQuantile("id", shares, 0.25 / runs) if shares else [])))

    @F.pandas_udf("int")
    def run_of(values: pd.Series) -> pd.Series:
        numbers = values.astype("float64").fillna(-np.inf)
        return pd.Series(np.searchsorted(cuts, numbers, side="right").astype("int32"))

    rows = docs.select(F.col(id_column).alias("id"), filled(F.col(text)).alias("text"))
    return rows.withColumn("run", run_of("id"))


def _followers(rows: DataFrame) -> DataFrame | None:
    """The first row of each run, under the number of the run that it follows."""
    # One row per run.
    firsts = rows.groupBy("run").agg(
        F.min("id").alias("id"), F.count_if(F.col("id").isNull()).alias("nulls")
    )
    found = sorted(firsts.collect(), key=lambda r: r.run)
    if not found:
        return None
    first = F.col("id").isin([r.id for r in found if not r.nulls])
    if any(r.nulls for r in found):
        first = first | F.col("id").isNull()
    # Of the other rows of a run with null ids, none has an id that begins a run.
    goes_to = {r.run: found[i - 1].run for i, r in enumerate(found)}
    target = F.create_map(*[F.lit(x) for pair in goes_to.items() for x in pair])
    texts = rows.filter(first).groupBy("run").agg(F.min("text").alias("text"))
    return texts.select(
        target[F.col("run")].alias("run"), F.lit(True).alias("follows"), "text"
    )


def beside_next(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K
) -> DataFrame:
    """Per row: the id, its fingerprint, that of its edited text, and how near these and the next are.

    Documents follow each other by ascending id (nulls first; equal ids by text), and the first
    follows the last. Rows are dealt to runs of neighbouring ids; the first row of each run is also
    dealt, as a mere follower, to the run before. So the texts move once, and a task sees each
    document and the one after it as a stream. Ids are numbers.
    """
    parts = shuffle_partitions(docs)
    rows = _numbered(docs, id_column, text, parts * RUNS)
    kind = rows.schema["id"].dataType
    both = rows.select("run", F.lit(False).alias("follows"), "id", "text")
    followers = _followers(rows)
    if followers is not None:
        both = both.unionByName(followers.withColumn("id", F.lit(None).cast(kind)))
    order = ["run", "follows", F.col("id").asc_nulls_first(), "text"]
    dealt = both.repartitionById(parts, F.pmod("run", F.lit(parts))).sortWithinPartitions(*order)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None
        id_kind = pa.int64()

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = [id_kind, *PAIR.values()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", *PAIR])

        for batch in batches:
            id_kind = batch.column(2).type
            for run, follows, name, value in zip(*batch.columns, strict=True):
                value = value.as_py()
                now = (run.as_py(), name.as_py(), value, sketch(value.encode(), k))
                if held is not None and held[0] == now[0]:
                    out.append((held[1], *_compared(held[2], held[3], now[2], now[3], k)))
                held = None if follows.as_py() else now
                if len(out) >= ROWS:
                    yield made()
        if out:
            yield made()

    return dealt.mapInArrow(pairs, f"id {kind.simpleString()}, {PAIR_TYPES}").withColumnRenamed(
        "id", id_column
    )
