"""Text expressions: numeric tokens, name squeezing, ASCII folding, word tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.numbers import as_number

# Blank characters that separate words.
BLANKS = r"[ \t\n\x0B\f\r]"


def positive_tokens(text: Column, separator: str = r"\|", any_token: bool = False) -> Column:
    """How many tokens are numbers above zero (or, with the flag, how many there are)."""
    tokens = F.split(text, separator)
    if any_token:
        return F.size(tokens).cast("long")
    kept = F.filter(tokens, lambda token: as_number(token) > 0)
    return F.size(kept).cast("long")


def squeezed(name: Column) -> Column:
    """A name without its spaces, so that it stays one word."""
    return F.replace(name, F.lit(" "), F.lit(""))


def _decomposer():
    """Compatibility decomposition, ASCII part only, a whole Arrow batch at a time.

    Defined in place so that it travels with the plan and executors need no copy of this package.
    """

    def decomposed(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return F.pandas_udf(decomposed, T.StringType())


def ascii_folded(text: Column) -> Column:
    """Accents and compatibility forms to plain ASCII; what has no ASCII form is dropped.

    Spark has no Unicode decomposition, so this one step is Python. Plain ASCII text is passed
    through: only the other rows' text is sent to it.
    """
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.when(~foreign, text).otherwise(_decomposer()(F.when(foreign, text)))


def split_words(text: Column, keep_blank: bool = False) -> Column:
    """Lower-case words, with a blank one where the text starts or ends with a separator.

    ``keep_blank`` splits at every single separator and drops only trailing blank words.
    """
    low = F.lower(text)
    if keep_blank:
        return F.split(F.regexp_replace(low, BLANKS + "+$", ""), BLANKS)
    return F.split(low, BLANKS + "+")


def words(text: Column, keep_blank: bool = False) -> Column:
    """The word list of a text; without ``keep_blank`` no word in it is blank."""
    split = split_words(text, keep_blank)
    return split if keep_blank else F.filter(split, lambda word: word != "")


def _counter():
    """Counts the words of each list of an Arrow batch; in place for the same reason as above."""

    def counted(lists: pa.Array) -> pa.Array:
        listed = pa.table({"row": pc.list_parent_indices(lists), "feature": pc.list_flatten(lists)})
        found = listed.group_by(["row", "feature"]).aggregate([([], "count_all")])
        # Groups come in no order.
        found = found.sort_by("row").combine_chunks()
        sizes = np.bincount(found["row"].to_numpy(), minlength=len(lists))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        values = [found["feature"].combine_chunks(), found["count_all"].combine_chunks()]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, ["feature", "tf"]))

    return F.arrow_udf(counted, T.ArrayType(T.StructType().add("feature", "string").add("tf", "long")))


def word_counts(words: Column) -> Column:
    """Each word of a list once, with how often it comes (feature, tf); no list gives no words."""
    return _counter()(words)


def _bucketer(buckets: int, beside: bool):
    """Adds hash buckets to the counted words of Arrow batches; in place for the same reason as above."""

    def hashed(words: pa.Array) -> np.ndarray:
        if len(words) == 0:
            return np.empty(0, np.int64)
        # MurmurHash 3 (32 bits, seed 42) of the UTF-8 bytes, as HashingTF has it; words of one length at once.
        coded = words.dictionary_encode()
        plain = coded.dictionary.cast(pa.large_binary())
        ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
        sizes = np.diff(ends)
        found = np.empty(len(plain), np.uint32)

        def turned(x: np.ndarray, by: int) -> np.ndarray:
            return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

        def mixed(k: np.ndarray) -> np.ndarray:
            return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for low, high in zip(edges, np.append(edges[1:], len(order)), strict=True):
            rows = order[low:high]
            size = int(sizes[rows[0]])
            h = np.full(len(rows), 42, np.uint32)
            for first in range(0, size, 4):
                k = np.zeros(len(rows), np.uint32)
                for i in range(min(4, size - first)):
                    k |= data[ends[rows] + first + i].astype(np.uint32) << np.uint32(8 * i)
                h ^= mixed(k)
                if first + 4 <= size:
                    h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(size)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            found[rows] = h ^ (h >> np.uint32(16))
        return (found.view(np.int32).astype(np.int64) % buckets)[coded.indices.to_numpy()]

    def bucketed(lists: pa.Array, *vector: pa.Array) -> pa.Array:
        flat = pc.list_flatten(lists)
        words, tf = pc.struct_field(flat, "feature"), pc.struct_field(flat, "tf")
        index = hashed(words)
        key = pc.list_parent_indices(lists).to_numpy().astype(np.int64) * buckets + index
        _, of = np.unique(key, return_inverse=True)
        n = np.bincount(of, tf.to_numpy()).astype(np.int64)[of] if len(of) else np.empty(0, np.int64)
        values = [words, tf, pa.array(index, pa.int32()), pa.array(n)]
        names = ["feature", "tf", "index", "n"]
        if beside:
            numbers, entries = vector
            # Rows in their order, and a vector's indices in theirs: sorted.
            at = pc.list_parent_indices(numbers).to_numpy().astype(np.int64) * buckets + pc.list_flatten(numbers).to_numpy()
            entry = pc.list_flatten(entries).to_numpy()
            place = np.minimum(np.searchsorted(at, key), max(0, len(at) - 1))
            none = np.ones(len(key), bool) if len(at) == 0 else at[place] != key
            values.append(pa.array(np.zeros(len(key)) if len(at) == 0 else entry[place], mask=none))
            names.append("beside")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names))

    word = T.StructType().add("feature", "string").add("tf", "long").add("index", "integer").add("n", "long")
    return F.arrow_udf(bucketed, T.ArrayType(word.add("beside", "double") if beside else word))


def word_buckets(counts: Column, buckets: int, beside: Column | None = None) -> Column:
    """Counted words (feature, tf) with ``index``, their hash bucket, and ``n``, how often the list has words of that.

    ``beside`` is a sparse vector by bucket: its entry for the word's bucket, or null, comes along.
    """
    if beside is None:
        return _bucketer(buckets, False)(counts)
    vector = F.unwrap_udt(beside)
    return _bucketer(buckets, True)(counts, vector["indices"], vector["values"])
