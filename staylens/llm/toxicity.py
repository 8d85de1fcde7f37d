"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

A text is taken as the short stretches that it is made of (``stretches``): words of at most ``WINDOW`` letters,
longer ones in overlapping windows, and single letters that stand in a row. Letters are code points that are
letters or digits, lower-cased; other characters inside a stretch are gaps, which only widen distances.

The kernel of two stretches counts their common subsequences of three and four letters. A subsequence that
spans s places weighs ``DECAY ** s``, and the kernel is scaled so that a stretch has 1 with itself. A letter put in
between, one left out, dots or blanks between the letters leave most subsequences, only wider ones, so
"i.d.i.o.t" and "idioot" stay near "idiot".

Landmarks are stretches of labelled sentences. With K the kernel of the landmarks and k(x) that of x with them,
K^(-1/2) k(x) stands for x (Nyström), and a linear machine with squared hinge loss is fitted there. What it
finds is f(x) = sum of a_j k(x, landmark j) + b. As the kernel is a product of subsequence weights, the sum over
landmarks is one table of weights by subsequence: scoring looks up the subsequences of x and never meets the
landmarks. A sentence is as toxic as its worst stretch, a text as its worst sentence; the score is the
logistic function of ``SLOPE`` times that.

Labels belong to documents, and most sentences of a toxic document are clean. So a stretch of any clean document
counts as clean. Of the rest, those that explain the toxic documents count as toxic: runs of four to eight
letters and whole stretches are taken greedily, by how surely they are commoner among the toxic (``SURE`` at
least) and how many documents they cover that none before them does; stretches that hold one are positive, and
the landmarks among them also stand with a letter put in.
Clean stretches that score highest join the training set and the landmarks, for ``ROUNDS`` rounds.

The machine is fitted on a bounded sample of labelled rows: ``TOXIC_DOCS`` and ``CLEAN_DOCS`` documents by the hash
of their ids, ``POSITIVES``, ``NEGATIVES`` and ``HARD`` stretches (a round), ``LANDMARKS`` of each kind. All
documents are scored, whole. Rows that ``held_out`` names never give a label. Language, source and id are no
inputs.

A null text is the empty text; a text without stretches has the score of the bias alone. A document is toxic if any
of its labels is 1 and clean if one is 0 and none 1; null labels and null ids say nothing. Copies and rows of
equal ids each get their score. Without both toxic and clean training rows all scores are 0. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import filled, let
from staylens.llm.simhash import fingerprint
from staylens.session import staged

# Fixed values of the kernel.
LENGTHS = (3, 4)
DECAY = 0.7
WINDOW = 12
STEP = 4

# Gap places beyond this many weigh alike, so that weights stay in range.
WIDEST = 40

# Bounds of the training sample.
TOXIC_DOCS = 1500
CLEAN_DOCS = 6000
POSITIVES = 3000
NEGATIVES = 6000
HARD = 500
LANDMARKS = 96

# Fixed values of training.
ROUNDS = 3
GRAMS = (4, 5, 6, 7, 8)
KNOWN_GRAMS = 20_000
SURE = 10.0
TWIN = 10
COST = 10.0

# Letters of a stretch that is also shown with a letter put in, and the share of the cost that this has.
MANGLED = (4, 11)
MANGLED_SHARE = 0.5
SLOPE = 3.0
FOLDS = 5

# Letters that the table of weights tells apart, and code points it looks up.
ALPHABET = 50
POINTS = 1 << 16

# Stretches scored at once, and scores that a worker remembers.
BATCH = 4096
REMEMBERED = 500_000

# Code points of texts whose stretches are looked up together, and texts that are unpacked together.
TOGETHER = 1 << 22
TEXTS = 512

# Signs that stand around words.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—"


# -- stretches


def windows(stretch: str) -> list[str]:
    """The stretch, or if it has more than ``WINDOW`` letters the windows of it, each in ``STEP`` letters."""
    if len(stretch) <= WINDOW:
        return [stretch]
    places = [i for i, c in enumerate(stretch) if c.isalnum()]
    if len(places) <= WINDOW:
        return [stretch]
    lasts = range(WINDOW, len(places) + STEP, STEP)
    return [stretch[places[max(0, n - WINDOW)] : places[min(n, len(places)) - 1] + 1] for n in lasts]


def stretches(text: str) -> set[str]:
    """The distinct stretches of a text."""
    words = text.lower().split()
    found: set[str] = set()
    for word in set(words):
        word = word.strip(EDGES)
        if len(word) <= WINDOW:
            found.add(word)
        else:
            found.update(windows(word))
    found.discard("")
    if len(words) >= LENGTHS[0]:
        single = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) == 1
        for low, high in runs(single, LENGTHS[0]):
            found.update(windows(" ".join(words[low:high])))
    return found


def runs(marks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where at least so many marks stand in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


# -- kernel


def letters(stretch: str) -> tuple[list[int], list[int]]:
    """Code points of the letters and their places."""
    held = [(ord(c), min(i, WIDEST)) for i, c in enumerate(stretch) if c.isalnum()]
    return [c for c, _ in held], [i for _, i in held]


def by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of equal numbers of letters: their positions in the list, code points and places."""
    plain: dict[int, list[int]] = {}
    gapped: dict[int, list[tuple]] = {}
    for at, stretch in enumerate(found):
        if stretch.isalnum():
            plain.setdefault(len(stretch), []).append(at)
        else:
            points, places = letters(stretch)
            gapped.setdefault(len(points), []).append((at, points, places))
    for size, rows in plain.items():
        for low in range(0, len(rows), BATCH):
            some = rows[low : low + BATCH]
            points = np.array([found[at] for at in some], dtype=f"<U{size}").view(np.uint32).reshape(-1, size)
            yield np.array(some), points.astype(np.int64), np.broadcast_to(np.arange(size), points.shape)
    for size, rows in gapped.items():
        for low in range(0, len(rows), BATCH):
            some = rows[low : low + BATCH]
            shape = (len(some), size)
            yield (
                np.array([r[0] for r in some]),
                np.array([r[1] for r in some], dtype=np.int64).reshape(shape),
                np.array([r[2] for r in some], dtype=np.int64).reshape(shape),
            )


def norms(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The kernel of each stretch with itself before scaling, square-rooted.

    ``ends[i, j]`` sums over pairs of subsequences that end at i and j; one more letter extends all that
    end before both.
    """
    if points.shape[1] < LENGTHS[0]:
        return np.zeros(len(points))
    same = points[:, :, None] == points[:, None, :]
    start, stop = DECAY ** -places.astype(np.float64), DECAY ** (places + 1.0)
    ends = same * (start[:, :, None] * start[:, None, :])
    stops = stop[:, :, None] * stop[:, None, :]
    square = np.zeros(len(points))
    for size in range(2, LENGTHS[-1] + 1):
        before = np.zeros_like(ends)
        before[:, 1:, 1:] = ends.cumsum(axis=1).cumsum(axis=2)[:, :-1, :-1]
        ends = same * before
        if size >= LENGTHS[0]:
            square += (ends * stops).sum(axis=(1, 2))
    return np.sqrt(square)


def subsequences(stretch: str) -> dict[tuple[int, ...], float]:
    """The weights of the subsequences of a stretch, scaled to length 1; none if it has too few letters."""
    points, places = letters(stretch)
    found: dict[tuple[int, ...], float] = {}
    for size in LENGTHS:
        for at in combinations(range(len(points)), size):
            key = tuple(points[i] for i in at)
            found[key] = found.get(key, 0.0) + DECAY ** (places[at[-1]] - places[at[0]] + 1)
    length = np.sqrt(sum(v * v for v in found.values()))
    return {k: v / length for k, v in found.items()}


class Landmarks:
    """The subsequences of the landmarks, numbered, with a row of weights (one for each landmark) for each.

    Letters beyond the ``ALPHABET`` most frequent of the landmarks count in norms and match nothing.
    """

    def __init__(self, landmarks: list[str]):
        counts: dict[int, int] = {}
        for stretch in landmarks:
            for point in letters(stretch)[0]:
                if point < POINTS:
                    counts[point] = counts.get(point, 0) + 1
        known = sorted(sorted(counts), key=lambda p: -counts[p])[:ALPHABET]
        self.base = len(known) + 1
        self.code = np.zeros(POINTS, dtype=np.int64)
        self.code[known] = np.arange(1, self.base)
        self.slots = [np.zeros(self.base**size, dtype=np.int32) for size in LENGTHS]
        rows = [np.zeros(len(landmarks), dtype=np.float32)]
        for column, stretch in enumerate(landmarks):
            for key, value in subsequences(stretch).items():
                if max(key) < POINTS and all(codes := [int(self.code[p]) for p in key]):
                    at = 0
                    for c in codes:
                        at = at * self.base + c
                    slots = self.slots[len(key) - LENGTHS[0]]
                    if slots[at] == 0:
                        slots[at] = len(rows)
                        rows.append(np.zeros(len(landmarks), dtype=np.float32))
                    rows[slots[at]][column] = value
        self.rows = np.array(rows)

    def summed(self, found: list[str], tables: list[np.ndarray], width: int) -> np.ndarray:
        """For each stretch the sum over its subsequences of weight times table entry, scaled by its norm."""
        out = np.zeros((len(found), width), dtype=np.float32)
        threes, fours = tables
        for at, points, places in by_length(found):
            size = points.shape[1]
            if size < LENGTHS[0]:
                continue
            codes = np.where(points < POINTS, self.code[np.minimum(points, POINTS - 1)], 0).T.copy()
            start = (DECAY ** -places.astype(np.float64)).T.astype(np.float32)[:, :, None]
            stop = (DECAY ** (places + 1.0)).T.astype(np.float32)[:, :, None]
            total = np.zeros((len(at), width), dtype=np.float32)
            for i, j in combinations(range(size - 1), 2):
                two = codes[i] * self.base + codes[j]
                ended = np.zeros((len(at), width), dtype=np.float32)
                for k in range(j + 1, size):
                    three = two * self.base + codes[k]
                    ended += stop[k] * threes[three]
                    for m in range(k + 1, size):
                        ended += stop[m] * fours[three * self.base + codes[m]]
                total += start[i] * ended
            out[at] = total / norms(points, places)[:, None]
        return out

    def kernel(self, found: list[str]) -> np.ndarray:
        """The kernel of each stretch with each landmark."""
        out = [np.zeros((0, self.rows.shape[1]), dtype=np.float32)]
        for low in range(0, len(found), BATCH):
            out.append(self.summed(found[low : low + BATCH], [Rows(s, self.rows) for s in self.slots], self.rows.shape[1]))
        return np.concatenate(out)

    def weighted(self, amounts: np.ndarray) -> Callable[[list[str]], np.ndarray]:
        """For lists of stretches, their kernels with the landmarks times the amounts, from one table."""
        weights = (self.rows @ amounts).astype(np.float32)
        tables = [weights[slots][:, None] for slots in self.slots]
        return lambda found: self.summed(found, tables, 1)[:, 0]


class Rows:
    """Table entries that are rows, found by their numbers."""

    def __init__(self, slots: np.ndarray, rows: np.ndarray):
        self.slots, self.rows = slots, rows

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.rows[self.slots[at]]


# -- the machine


def nystrom_map(kernel: np.ndarray) -> np.ndarray:
    """The matrix that takes kernels with the landmarks to Nyström features, from that among themselves."""
    values, vectors = np.linalg.eigh((kernel + kernel.T).astype(np.float64) / 2)
    kept = values > 1e-4
    return vectors[:, kept] / np.sqrt(values[kept])


def fit_linear(rows: np.ndarray, signs: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of least ``|w|^2 / 2 + sum of cost * max(0, 1 - sign * f)^2``, by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        short = np.maximum(0, 1 - signs * (x @ w))
        return float((ridge * w * w).sum() / 2 + (costs * short * short).sum())

    w = np.zeros(x.shape[1])
    for _ in range(50):
        short = 1 - signs * (x @ w)
        inside = short > 0
        near = x[inside]
        slope = ridge * w - 2 * near.T @ (costs[inside] * signs[inside] * short[inside])
        bend = np.diag(ridge) + 2 * (near.T * costs[inside]) @ near
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class ToxicityModel:
    """Landmarks with their amounts, and the bias. Without landmarks nothing was learnt."""

    landmarks: tuple[str, ...]
    amounts: tuple[float, ...]
    bias: float

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        """f for lists of stretches."""
        weighted = Landmarks(list(self.landmarks)).weighted(np.array(self.amounts))
        return lambda found: weighted(found) + self.bias


def with_insertions(stretch: str) -> list[str]:
    """The stretch with a letter that it lacks put in at each inner place; none if it is too short or long."""
    other = next((c for c in "xqzjk" if c not in stretch), None)
    if other is None or not stretch.isalnum() or not MANGLED[0] <= len(stretch) <= MANGLED[1]:
        return []
    return [stretch[:i] + other + stretch[i:] for i in range(1, len(stretch))]


def fit_machine(positives: dict[str, float], negatives: list[str], landmarks: list[str]) -> ToxicityModel:
    """The machine for positive stretches, each with its share of the cost, and negative ones."""
    known = Landmarks(landmarks)
    to_features = nystrom_map(known.kernel(landmarks))
    rows = known.kernel([*positives, *negatives]).astype(np.float64) @ to_features
    signs = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
    costs = COST * np.concatenate([np.array(list(positives.values())), np.ones(len(negatives))])
    w, bias = fit_linear(rows, signs, costs)
    return ToxicityModel(tuple(landmarks), tuple((to_features @ w).tolist()), bias)


# -- training rows


def held_out(ids: Column) -> Column:
    """Rows that never give a label."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, toxic, fp, stretch) from (doc, toxic, text); ``fp`` is the text's SimHash."""
    kinds = {"doc": pa.int64(), "toxic": pa.bool_(), "fp": pa.int64(), "stretch": pa.string()}
    for batch in batches:
        for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = sorted(stretches(text.decode("utf-8", "replace")))
            fp = int(np.uint64(fingerprint(text)).astype(np.int64))
            columns = [[doc] * len(found), [toxic] * len(found), [fp] * len(found), found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
            )


def training_stretches(docs: DataFrame, labels: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows (doc, toxic, fp, stretch) of the sample: documents by the hash of their ids, equal texts once."""
    said = (
        labels.filter(F.col(id_column).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_column)))
        .groupBy(F.col(id_column).alias("id"))
        .agg((F.max("toxic") == 1).alias("toxic"))
    )
    order = F.xxhash64("id"), F.col("id")
    chosen = said.filter("toxic").orderBy(*order).limit(TOXIC_DOCS).unionByName(
        said.filter("not toxic").orderBy(*order).limit(CLEAN_DOCS)
    )
    texts = docs.select(F.col(id_column).alias("id"), filled(F.col(text)).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy(F.sha2("text", 256)).agg(
        F.min(F.struct(F.xxhash64("id"), "toxic", "text")).alias("row")
    )
    # A text with labels of both kinds counts as what its first id says.
    rows = rows.select(F.col("row.col1").alias("doc"), "row.toxic", "row.text")
    return staged(
        rows.mapInArrow(_stretch_batches, "doc long, toxic boolean, fp long, stretch string"), "toxicity-stretches"
    )


def held_letters(stretch: Column) -> Column:
    return F.regexp_replace(stretch, r"[^\p{L}\p{N}]", "")


def grams_of(stretch: Column) -> Column:
    """The distinct runs of ``GRAMS`` letters of a stretch, gaps left out, and the whole of it between marks."""

    def cut(held: Column, size: int) -> Column:
        lows = F.sequence(F.lit(1), F.greatest(F.length(held) - (size - 1), F.lit(1)))
        found = F.transform(lows, lambda i: F.substring(held, i, F.lit(size)))
        return F.filter(found, lambda g: F.length(g) == size)

    def all_of(held: Column) -> Column:
        whole = F.array(F.concat(F.lit("^"), held, F.lit("$")))
        return F.array_distinct(F.concat(whole, *(cut(held, size) for size in GRAMS)))

    return let(held_letters(stretch), all_of)


def telling(inside: int, outside: int, toxic_docs: int, clean_docs: int) -> float:
    """How surely more of the toxic than of the clean have a gram: the logarithm of the odds against chance."""
    share, usual = inside / (inside + outside), toxic_docs / (toxic_docs + clean_docs)
    if share <= usual:
        return 0.0
    rest = outside * np.log((1 - share) / (1 - usual)) if outside else 0.0
    return float(inside * np.log(share / usual) + rest)


def leaders(prints: dict[int, int]) -> dict[int, int]:
    """For each document of a bounded sample, the first one that is its near copy (``TWIN`` bits or fewer)."""
    led: dict[int, int] = {}
    fps = np.zeros(0, dtype=np.uint64)
    heads: list[int] = []
    for doc, fp in sorted(prints.items()):
        near = np.flatnonzero(np.bitwise_count(fps ^ np.uint64(fp)) <= TWIN)
        if len(near) == 0:
            heads.append(doc)
            fps = np.append(fps, np.uint64(fp))
        led[doc] = heads[near[0]] if len(near) else doc
    return led


def covering_grams(rows: list, led: dict[int, int], clean_docs: int) -> list[str]:
    """Telling grams that cover the toxic documents that any covers, the most telling first.

    ``rows`` hold ``gram``, ``docs`` (toxic documents it occurs in) and ``clean`` (occurrences among the clean);
    near copies count as one. Grams without clean occurrences and twice as sure are taken in any case.
    """
    toxic_docs = len(set(led.values()))
    docs = {r.gram: {led[d] for d in r.docs} for r in rows}
    sure = {r.gram: telling(len(docs[r.gram]), r.clean, toxic_docs, clean_docs) for r in rows}
    plain = [r.gram for r in rows if r.clean == 0 and sure[r.gram] >= 2 * SURE]
    docs = {g: d for g, d in docs.items() if sure[g] >= SURE}
    gain = {g: sure[g] for g in docs}
    covered: set[int] = set()
    taken = []
    while gain:
        best = max(gain, key=lambda g: (gain[g], g))
        now = sum(d not in covered for d in docs[best])
        fresh = sure[best] * now / len(docs[best])
        if now == 0:
            del gain[best]
        elif fresh < gain[best]:
            gain[best] = fresh  # less than it was; look again whether it is still the best
        else:
            taken.append(best)
            del gain[best]
            covered.update(docs[best])
    return list(dict.fromkeys([*taken, *sorted(plain, key=lambda g: (-sure[g], g))]))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> ToxicityModel:
    """The machine fitted on the sample; Spark gathers and scores stretches, the driver gets bounded lists."""
    rows = training_stretches(docs, labels, id_column, text)
    # One row for each document of the sample, at most TOXIC_DOCS + CLEAN_DOCS.
    known = rows.groupBy("doc", "toxic").agg(F.min("fp").alias("fp")).collect()
    led = leaders({r.doc: r.fp & (1 << 64) - 1 for r in known if r.toxic})
    clean_docs = sum(not r.toxic for r in known)
    if not led or not clean_docs:
        return ToxicityModel((), (), 0.0)
    counted = staged(
        rows.groupBy("stretch").agg(
            F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")
        ),
        "toxicity-counts",
    )
    only_toxic, clean = counted.filter("clean = 0"), counted.filter("clean > 0")

    # Grams of stretches that no clean document has, and how often the clean have them elsewhere.
    gram = F.explode(grams_of(F.col("stretch"))).alias("gram")
    inside = (
        rows.filter("toxic")
        .join(only_toxic.select("stretch"), "stretch")
        .select("doc", gram)
        .groupBy("gram")
        .agg(F.collect_set("doc").alias("docs"))
        .filter(F.size("docs") >= 2)
    )
    outside = clean.select(gram, "clean").groupBy("gram").agg(F.sum("clean").alias("clean"))
    best = (
        inside.join(outside, "gram", "left")
        .select("gram", "docs", F.coalesce("clean", F.lit(0)).alias("clean"))
        .orderBy(F.desc(F.size("docs") / (F.col("clean") + 1)), "gram")
        .limit(KNOWN_GRAMS)
    )
    taken = covering_grams(best.collect(), led, clean_docs)
    chosen = docs.sparkSession.createDataFrame([(g,) for g in taken], "gram string")
    toxic = (
        only_toxic.select("stretch", "toxic", gram)
        .join(F.broadcast(chosen), "gram")
        .select("stretch", "toxic")
        .distinct()
        .orderBy(F.desc("toxic"), "stretch")
        .limit(POSITIVES)
        .collect()
    )
    if not toxic:
        return ToxicityModel((), (), 0.0)
    # A stretch of many documents costs more, within bounds.
    positives = {r.stretch: float(min(10, r.toxic)) for r in toxic}
    negatives = [
        r.stretch for r in clean.orderBy(F.xxhash64("stretch"), "stretch").limit(NEGATIVES).collect()
    ]
    shown = list(positives)[:LANDMARKS]
    clean_ones = set(negatives)
    for stretch in shown:
        for mangled in with_insertions(stretch):
            if mangled not in clean_ones:
                positives.setdefault(mangled, MANGLED_SHARE)
    hard: list[str] = []
    model = ToxicityModel((), (), 0.0)
    for turn in range(ROUNDS):
        landmarks = list(dict.fromkeys([*shown, *hard[:LANDMARKS], *negatives[: LANDMARKS // 2]]))
        model = fit_machine(positives, [*negatives, *hard], landmarks)
        if turn < ROUNDS - 1:
            worst = scored_stretches(clean, model).orderBy(F.desc("f"), "stretch").limit(HARD)
            hard = list(dict.fromkeys([*(r.stretch for r in worst.collect()), *hard]))
    return model


# -- scores


def scored_stretches(found: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row of a table of stretches: ``stretch`` and its ``f``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part in parts:
            some = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(some), pa.float64())], names=["stretch", "f"])

    return found.select("stretch").mapInArrow(batches, "stretch string, f double")


# What a worker keeps between tasks: the model, its scorer and the scores of stretches it met.
_KEPT: list = []


def _remembered(model: ToxicityModel) -> tuple[Callable, dict[str, float]]:
    if not _KEPT or _KEPT[0] != model:
        _KEPT[:] = [model, model.scorer(), {}]
    return _KEPT[1], _KEPT[2]


def text_scores(texts: list[str], model: ToxicityModel) -> list[tuple[float, str | None]]:
    """Per text: its score and the stretch it has it from."""
    if not model.landmarks:
        return [(0.0, None)] * len(texts)
    score, known = _remembered(model)
    out, low = [], 0
    while low < len(texts):
        found: list[set[str]] = []
        size = 0
        while low < len(texts) and size < TOGETHER:
            found.append(stretches(texts[low]))
            size += len(texts[low])
            low += 1
        fresh = list(set().union(*found).difference(known))
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set().union(*found))
        known.update(zip(fresh, score(fresh).tolist(), strict=True))
        for some in found:
            worst = max(some, key=lambda x: (known[x], x), default=None)
            f = model.bias if worst is None else known[worst]
            out.append((float(1 / (1 + np.exp(-SLOPE * f))), worst))
    return out


def scored(
    docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the id, ``score`` and ``worst``, the stretch that the score comes from."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part.slice(low, TEXTS) for part in parts for low in range(0, part.num_rows, TEXTS)):
            texts = [t.decode("utf-8", "replace") for t in some.column(1).to_pylist()]
            found = text_scores(texts, model)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0),
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([w for _, w in found], pa.string()),
                ],
                names=["id", "score", "worst"],
            )

    rows = docs.select(F.col(id_column).alias("id"), filled(F.col(text)).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"id {kind}, score double, worst string").withColumnRenamed("id", id_column)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the id, ``held_out``, ``score``, ``predicted`` and ``worst``, by a machine trained on the others."""
    model = train(docs, labels, id_column, text)
    return scored(docs, model, id_column, text).select(
        id_column,
        held_out(F.col(id_column)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst",
    )
