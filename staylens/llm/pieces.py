"""SentencePiece encoding and decoding by a table of last tokens.

Each prefix of a text has its own encoding, and that encoding has one last token. A token can be the last
of a prefix only if it ends there, and it is exactly if it stands next to the last token of what lies
before it in the encoding of those two alone. So the table is filled from left to right: an automaton over
the vocabulary names the tokens that end at each place, and a test on pairs picks the one that fits. The
ids are then read backwards from the last entry. The time is in proportion to the text, however long.

The vocabulary is a merge (BPE) model with byte fallback. No piece holds a space behind another character,
so a text falls apart in front of its spaces; it also does in front of a line end, comma or full stop behind
a character that no piece has before one. Each part is encoded once per worker while a bounded memory of
parts lasts. Characters outside the vocabulary become the tokens of their bytes.

A null text is the empty text: only the begin and end ids. Copies and equal ids give equal rows. Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"

# Marks where a text is cut; a text that holds it itself is cut at its spaces only.
CUT = "\ue000"
STOPS = "\n,."

# Parts and pairs that a worker remembers, and the longest part worth it.
PARTS = 800_000
PAIRS = 1_000_000
PART_CHARS = 64

# Rows that are encoded before they are handed on.
ROWS = 256


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """A byte that is no text becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("replace-each", _each_byte)


class Vocabulary:
    """The pieces of a model, and encoding and decoding with them."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.piece: list[str | None] = [None] * size
        self.output = [b""] * size
        self.byte_id = [0] * 256
        self.ids: dict[str, int] = {}
        self.score = [0.0] * size
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_id[value], self.output[i] = i, bytes([value])
            elif model.is_unknown(i):
                self.output[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.piece[i], self.ids[text], self.score[i] = text, i, model.get_score(i)
                self.output[i] = text.replace(SPACE, " ").encode()
        self.length = [len(p) if p else 0 for p in self.piece]
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.whole = {i: self.merged(text) == [i] for text, i in self.ids.items()}
        self.size = size
        # By left * size + right.
        self.fits: dict[int, bool] = {}
        # Parts used of late, and those used before them.
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        held: dict[str, set[str]] = {c: set() for c in STOPS}
        for text in self.ids:
            for before, stop in zip(text, text[1:], strict=False):
                if stop in held:
                    held[stop].add(before)
        cuts = [
            f"{re.escape(c)}(?<![{re.escape(''.join(sorted(b | {CUT})))}]{re.escape(c)})"
            for c, b in held.items()
        ]
        self.cuts = re.compile(f"(?:{'|'.join(cuts)})")

    def merged(self, text: str) -> list[int]:
        """The ids of a few characters by merging, best score first; used on pairs of pieces."""
        symbols = list(text)
        ids, score, none = self.ids, self.score, float("-inf")

        def joined(i: int) -> float:
            found = ids.get(symbols[i] + symbols[i + 1])
            return none if found is None else score[found]

        scores = [joined(i) for i in range(len(symbols) - 1)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = joined(at - 1)
            if at < len(scores):
                scores[at] = joined(at)
        return [ids.get(s, -1) for s in symbols]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their texts meet."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.merged(self.piece[left] + self.piece[right]) == [left, right]
        self.fits[left * self.size + right] = known
        return known

    def last_tokens(self, part: str) -> list[int]:
        """For each prefix of ``part`` its last token; -1 where that is a character without one."""
        last = [-1] * len(part)
        length, whole, known, size = self.length, self.whole, self.fits.get, self.size
        for end, token in self.automaton.iter(part):
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start < 0 or (left := last[start]) < 0:
                good = whole[token]
            else:
                good = known(left * size + token)
                if good is None:
                    good = self.compatible(left, token)
            if good:
                last[end] = token
        return last

    def encode_part(self, part: str) -> bytes:
        """The ids of a part as little-endian unsigned 32-bit numbers."""
        # A mark in front is that of a cut; a text with marks of its own has none in front of a part.
        part = part.removeprefix(CUT)
        last = self.last_tokens(part)
        ids, at = [], len(part) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                ids.extend(self.byte_id[b] for b in reversed(part[at].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= self.length[token]
        ids.reverse()
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, with begin and end, as little-endian unsigned 32-bit numbers."""
        inner = b""
        if text:
            spaced = SPACE + text.replace(" ", SPACE)
            if CUT in spaced:
                parts = AT_SPACES.findall(spaced)
            else:
                parts = AT_CUTS.findall(self.cuts.sub(f"{CUT}\\g<0>", spaced))
            if len(self.parts) >= PARTS // 2:
                self.older, self.parts = self.parts, {}
            long_parts = {}
            for part in set(parts).difference(self.parts):
                if len(part) <= PART_CHARS:
                    self.parts[part] = self.older.get(part) or self.encode_part(part)
                else:
                    long_parts[part] = self.encode_part(part)
            if long_parts:
                inner = b"".join(long_parts.get(p) or self.parts[p] for p in parts)
            else:
                inner = b"".join(map(self.parts.__getitem__, parts))
        ends = np.array([self.begin, self.end], dtype="<u4").tobytes()
        return ends[:4] + inner + ends[4:]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding put in front goes."""
        found = np.frombuffer(ids, dtype="<u4")
        numbers = found.tolist()
        control = np.flatnonzero((found == self.begin) | (found == self.end))
        if np.any((control > 0) & (control < len(found) - 1)):
            # Bytes on both sides of a control token make no character together.
            parts = np.split(found, control)
            texts = [b"".join(map(self.output.__getitem__, p.tolist())) for p in parts]
            raw = b"".join(t.decode("utf-8", "replace-each").encode() for t in texts)
        else:
            raw = b"".join(map(self.output.__getitem__, numbers))
        first = next((i for i in numbers if i not in (self.begin, self.end)), None)
        if first is not None and (self.piece[first] or "").startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace-each")


# Spaces stand in front of what they belong to; the first part always has one.
AT_SPACES = re.compile(f"{SPACE}+[^{SPACE}]*")
AT_CUTS = re.compile(f"(?:{SPACE}+|{CUT})[^{SPACE}{CUT}]*")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` (array of token ids with begin and end) and ``n_tokens``."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in rows:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                raw = [words.encode(t or "") for t in part.column(1).to_pylist()]
                sizes = [len(r) // 4 for r in raw]
                values = pa.array(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32))
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(sizes, pa.int64())],
                    names=["id", "ids", "n_tokens"],
                )

    return _mapped(docs, id_column, F.col(text).cast("string"), batches, "ids array<int>, n_tokens bigint")


def decoded(
    rows: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """Per row: the id and ``decoded``, the text of its token ids."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in found:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                texts = [
                    words.decode(np.array(x or [], dtype="<u4").tobytes())
                    for x in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    return _mapped(rows, id_column, F.col(ids), batches, "decoded string")


def round_trip(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the id, ``n_tokens``, and the digests of the ids and of what they decode to.

    The ids are digested as little-endian unsigned 32-bit numbers, the text in UTF-8; encoding and
    decoding happen in one pass, so neither ids nor texts are moved.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in rows:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                sizes, digests, texts = [], [], []
                for value in part.column(1).to_pylist():
                    raw = words.encode(value or "")
                    sizes.append(len(raw) // 4)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    texts.append(hashlib.sha256(words.decode(raw).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _mapped(
        docs,
        id_column,
        F.col(text).cast("string"),
        batches,
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _mapped(rows: DataFrame, id_column: str, value, batches, columns: str) -> DataFrame:
    """The id, whatever its type and name, with the columns that ``batches`` makes of ``value``."""
    narrow = rows.select(F.col(id_column).alias("id"), value.alias("value"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"id {kind}, {columns}").withColumnRenamed("id", id_column)
