"""Token counts from the frequencies of pre-tokens.

A tokenizer first cuts a text into pre-tokens and then each of them into pieces, so a document has as many
tokens as the sum, over its distinct pre-tokens, of frequency times pieces. The corpus is read twice. The
first pass counts pre-tokens over all documents, and each distinct one is cut into pieces once. The second
gives the pre-token frequencies of each document, which are joined with those counts and summed; token ids
are never made.

The most frequent pre-tokens, at most ``HEAD`` of at most ``HEAD_CHARS`` characters, go to every task and
are summed where they are counted. All others take part in a join, so the result is exact at any size; of
those none but a very long one is frequent, and a hot one is split at run time.

Texts are cut at ASCII white space first. The tokenizer's normalizer and pre-tokenizer treat what lies
between independently, so a word is cut once per worker while a bounded memory of words lasts. Strings of
the special tokens count as the library takes them, as one token.

A null text is the empty text, with 0 tokens. Copies and equal ids keep their rows. Only the id and the
text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staylens.llm.common import filled
from staylens.session import staged

# Pre-tokens sent to every task: at most so many, of at most so many characters.
HEAD = 131_072
HEAD_CHARS = 64

# Words that a worker remembers or counts at once.
WORDS = 250_000

# Documents whose words are looked up together.
DOCUMENTS = 64

# Rows handed on at once.
ROWS = 50_000


class PreTokens:
    """Cuts words into pre-tokens and those into pieces, as the library does."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        longest_first = sorted(self.special, key=len, reverse=True)
        names = "|".join(map(re.escape, longest_first))
        self.cut_special = re.compile(f"({names})" if names else r"(?!)")
        self.known: dict[bytes, tuple[str, ...]] = {}
        self._learn_simple(json.loads(self.tokenizer.to_str()))

    def _learn_simple(self, config: dict) -> None:
        """The characters whose words need no library call, found by trying each on the library.

        A word of Latin letters, digits and signs is in normal form; what remains is to put it in lower
        case, to cut it by the tokenizer's own pattern and to name its bytes. This holds for
        normalizers and pre-tokenizers of the kinds below; other tokenizers get no such characters.
        """
        self.simple, self.names = re.compile(r"(?!)"), {}
        normal = (config["normalizer"] or {}).get("normalizers", [])
        before = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in normal], [x["type"] for x in before]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            return
        split, named = before
        if not split["invert"] or split["behavior"] != "Removed" or named["use_regex"]:
            return
        chars = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)]]
        pattern, good = split["pattern"]["Regex"], []
        for kind in (r"\p{L}", r"\p{N}"):
            # Only these characters will be met, so a class is the list of its members among them.
            pattern = pattern.replace(kind, "".join(c for c in chars if regex.match(kind, c)))
        self.pattern = re.compile(pattern)
        for char in chars:
            lower = char.lower()
            if self._cut(lower)[0] == lower and len(lower) == 1:
                self.names[ord(lower)] = "".join(p for p, _ in self._cut(lower)[1])
        for char in chars:
            if ord(char.lower()[0]) in self.names and self._simply(char) == self._alone(char):
                good.append(char)
        self.simple = re.compile(f"[{re.escape(''.join(good))}]{{1,256}}")

    def _simply(self, text: str) -> tuple[str, ...]:
        text = text.lower()
        parts = self.pattern.findall(text)
        return tuple(parts if text.isascii() else [p.translate(self.names) for p in parts])

    def learn(self, words: Iterable[bytes]) -> dict[bytes, tuple[str, ...]]:
        """The pre-tokens of at least these words; forgets others when there are too many."""
        known = self.known
        if len(known) >= WORDS:
            known.clear()
        for word in words:
            if word not in known:
                text = word.decode()
                simple = self.simple.fullmatch(text) and not self.cut_special.search(text)
                known[word] = self._simply(text) if simple else self._alone(text)
        return known

    def _cut(self, text: str) -> tuple[str, list]:
        normal = self.tokenizer.normalizer.normalize_str(text)
        return normal, self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)

    def _alone(self, text: str) -> tuple[str, ...]:
        parts: list[str] = []
        for part in self.cut_special.split(text):
            if part in self.special:
                parts.append(part)
            elif part:
                parts += [p for p, _ in self._cut(part)[1]]
        return tuple(parts)

    def pieces(self, pre_token: str) -> int:
        if pre_token in self.special:
            return 1
        return len(self.tokenizer.model.tokenize(pre_token))


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One per worker process."""
    return PreTokens(path)


def corpus_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each distinct pre-token of all texts: ``token``, ``n`` (times it occurs), ``pieces``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = pre_tokens(path), Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            parts: dict[str, int] = defaultdict(int)
            known = cutter.learn(seen)
            for word, n in seen.items():
                for part in known[word]:
                    parts[part] += n
            seen.clear()
            names, amounts = list(parts), list(parts.values())
            for low in range(0, len(names), ROWS):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[low : low + ROWS], pa.string()),
                        pa.array(amounts[low : low + ROWS], pa.int64()),
                    ],
                    names=["token", "n"],
                )

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                seen.update((value.as_py() or b"").split())
                if len(seen) >= WORDS:
                    yield from flushed()
        yield from flushed()

    def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path)
        for batch in batches:
            sizes = [cutter.pieces(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64())], names=["token", "n", "pieces"]
            )

    rows = docs.select(F.col(text).cast("string").alias("text"))
    distinct = rows.mapInArrow(counted, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return staged(distinct.mapInArrow(in_pieces, "token string, n bigint, pieces bigint"), "pre-tokens")


def head_threshold(counts: DataFrame, most: int = HEAD) -> int:
    """The least frequency from which on there are at most ``most`` pre-tokens."""
    # Quarter octaves: a few hundred rows whatever the corpus.
    step = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("size"), F.min("n").alias("least"))
    room, threshold = most, None
    for row in sorted(rows.collect(), key=lambda r: -r.step):
        room -= row["size"]
        if room < 0:
            break
        threshold = row.least
    return threshold if threshold is not None else 2**62


def document_counts(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text: str = "text",
    head: int = HEAD,
) -> DataFrame:
    """Per row: the id, ``n_bytes`` (of the text in UTF-8) and ``n_tokens``."""
    counts = corpus_counts(docs, path, text)
    frequent = (F.col("n") >= head_threshold(counts, head)) & (F.length("token") <= HEAD_CHARS)
    first = counts.filter(frequent).select("token", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(
        dict(zip(first.column(0).to_pylist(), first.column(1).to_pylist(), strict=True))
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, pieces = pre_tokens(path), known.value
        row = TaskContext.get().partitionId() << 40
        # A word's pieces among the frequent pre-tokens, and its other pre-tokens.
        short: dict[bytes, tuple[int, tuple[str, ...]]] = {}

        def learn(some: Iterable[bytes]) -> None:
            if len(short) >= WORDS:
                short.clear()
            fresh = set(some).difference(short)
            known = cutter.learn(fresh)
            for word in fresh:
                parts = known[word]
                rest = tuple(p for p in parts if p not in pieces)
                short[word] = sum(pieces[p] for p in parts if p in pieces), rest

        def made(out) -> pa.RecordBatch:
            kinds = [pa.int64(), id_kind, pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n_bytes", "token", "amount"])

        out: tuple[list, ...] = ([], [], [], [], [])
        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.column(0).type
            for low in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(low, DOCUMENTS)
                counts = [
                    Counter((t.as_py() or b"").split()) for t in part.column(2).cast(pa.binary())
                ]
                learn(word for c in counts for word in c)
                for name, size, count in zip(part.column(0), part.column(1), counts, strict=True):
                    row += 1
                    amount, rest = 0, defaultdict(int)
                    for word, n in count.items():
                        own, others = short[word]
                        amount += n * own
                        for other in others:
                            rest[other] += n
                    cells = (row, name.as_py(), size.as_py(), None, amount)
                    for column, cell in zip(out, cells, strict=True):
                        column.append(cell)
                    more = len(rest)
                    for column, cell in zip(out, ([row], [None], [None], None, None), strict=True):
                        if cell is not None:
                            column.extend(cell * more)
                    out[3].extend(rest)
                    out[4].extend(rest.values())
                if len(out[0]) >= ROWS:
                    yield made(out)
            if out[0]:
                yield made(out)

    rows = docs.select(
        F.col(id_column).alias("id"),
        F.octet_length(filled(F.col(text))).cast("long").alias("n_bytes"),
        F.col(text).cast("string").alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = staged(
        rows.mapInArrow(
            frequencies, f"row bigint, id {kind}, n_bytes bigint, token string, amount bigint"
        ),
        "frequencies",
    )
    others = counts.filter(~frequent).select("token", "pieces")
    rest = (
        found.filter(F.col("token").isNotNull())
        .select("row", "token", "amount")
        .join(others, "token")
        .groupBy("row")
        .agg(F.sum(F.col("amount") * F.col("pieces")).alias("rest"))
    )
    return (
        found.filter(F.col("token").isNull())
        .select("row", "id", "n_bytes", "amount")
        .join(rest, "row", "left")
        .select(
            F.col("id").alias(id_column),
            "n_bytes",
            (F.col("amount") + F.coalesce("rest", F.lit(0))).cast("long").alias("n_tokens"),
        )
    )
