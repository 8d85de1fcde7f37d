"""The string-kernel machine: the kernel against its definition, held-out accuracy, odd tables."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from staylens.llm import toxicity

CLASH = ", ".join(f"{c} int" for c in ("id", "score", "worst", "stretch", "doc", "f", "gram", "predicted_"))
SYLLABLES = "en er ch te und ver lich ein sch ung keit heit the on an th re ti".split()
INSULTS = ["blorgut", "wazzock", "grimpet", "zunkel"]


def plain_kernel(one, other):
    """By definition: common subsequences of three and four letters, weighed by the places they span."""

    def weights(stretch):
        held = [(c, i) for i, c in enumerate(stretch) if c.isalnum()]
        found = {}
        for size in (3, 4):
            for part in combinations(held, size):
                key = "".join(c for c, _ in part)
                found[key] = found.get(key, 0) + 0.7 ** (part[-1][1] - part[0][1] + 1)
        return found

    a, b = weights(one), weights(other)
    if not a or not b:
        return 0.0
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    return dot / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


STRETCHES = ["idiot", "i.d.i.o.t", "i d i o t", "idioot", "aaaaaa", "ab", "abc", "", "...", "scum", "ünïcödé", "中文字符中", "a-b-c-d", "loweichen", "mississippi", "x" * 12]


def test_kernel_is_as_defined():
    landmarks = ["idiot", "scum", "mississippi", "a.b.c.d", "中文字符", "aaaa"]
    found = toxicity.Landmarks(landmarks).kernel(STRETCHES)
    for i, x in enumerate(STRETCHES):
        for j, y in enumerate(landmarks):
            assert found[i, j] == pytest.approx(plain_kernel(x, y), abs=1e-5), (x, y)


def test_folded_weights_equal_the_sum_over_landmarks():
    rng = random.Random(1)
    landmarks = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))[:12] for _ in range(40)]
    amounts = np.array([rng.uniform(-2, 2) for _ in landmarks])
    known = toxicity.Landmarks(landmarks)
    found = [*STRETCHES, *("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))[:12] for _ in range(500))]
    assert known.weighted(amounts)(found) == pytest.approx(known.kernel(found) @ amounts, abs=1e-4)


def test_gaps_and_insertions_stay_near():
    near = [plain_kernel("idiot", x) for x in ("i.d.i.o.t", "i d i o t", "id-iot", "idioot", "idxiot")]
    assert near[0] > 0.9 and near[1] > 0.9 and near[2] > 0.9 and min(near) > 0.35
    assert max(plain_kernel("idiot", x) for x in ("edition", "tradition", "riot", "ideal")) < 0.4


def test_nystrom_features_give_the_kernel_of_the_landmarks():
    landmarks = ["idiot", "scum", "moron", "trash", "clown", "idiots", "loser", "closer"]
    known = toxicity.Landmarks(landmarks)
    k = known.kernel(landmarks)
    features = k @ toxicity.nystrom_map(k)
    assert features @ features.T == pytest.approx(k, abs=1e-3)


def test_linear_machine_finds_the_least_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    signs = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 > rng.normal(size=300) * 0.3, 1.0, -1.0)
    costs = rng.uniform(0.5, 5, size=300)
    w, b = toxicity.fit_linear(x, signs, costs)

    def loss(w, b):
        return w @ w / 2 + (costs * np.maximum(0, 1 - signs * (x @ w + b)) ** 2).sum()

    least = loss(w, b)
    assert all(loss(w + rng.normal(size=4) * s, b + rng.normal() * s) > least for s in (1e-3, 0.1) for _ in range(50))


def test_stretches_hold_the_whole_text():
    text = "Idiot! a b c d. " + "abcdefghijklmnopqrstuvwxyz" * 3 + " i.d.i.o.t...,  x-y"
    found = toxicity.stretches(text)
    assert {"idiot", "i.d.i.o.t", "x-y", "a", "d"} <= found
    assert any(x.startswith("a b c") for x in found)
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    for i in range(len(long) - 8):
        assert any(long[i : i + 9] in x for x in found)
    assert all(sum(c.isalnum() for c in x) <= 12 for x in found)
    assert toxicity.stretches("") == toxicity.stretches(" ... !") == set()
    assert toxicity.stretches("a b") == {"a", "b"}


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def insulted(rng, text, words):
    parts = text.split()
    for _ in range(rng.randint(1, 3)):
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(words))
    return " ".join(parts)


def corpus(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        text = prose(rng, rng.randint(20, 80))
        rows.append((i, insulted(rng, text, INSULTS) if toxic else text))
        labels.append((i, int(rng.random() < 0.5), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    extra = len(CLASH.split(", "))
    docs = spark.createDataFrame([(*r, *range(extra)) for r in rows], f"doc_id long, text string, {CLASH}")
    return docs, spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, text int")


def test_held_out_rows_and_hidden_insults(spark):
    rows, labels = corpus(1, 500)
    rng = random.Random(2)
    hidden = [".".join(w) for w in INSULTS] + [" ".join(w) for w in INSULTS] + [w[:3] + "-" + w[3:] for w in INSULTS]
    hidden += [w[:3] + w[2:] for w in INSULTS]
    odd = [(1000 + i, f"{prose(rng, 30)} {h} {prose(rng, 30)}") for i, h in enumerate(hidden)]
    clean = [(2000 + i, prose(rng, 60)) for i in range(100)]
    docs, marks = frames(spark, [*rows, *odd, *clean, (3000, None), (3001, ""), (3002, "?!"), (None, "wazzock")], labels)
    out = toxicity.toxicity(docs, marks)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "worst"]
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == out.count()
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found if i is not None)
    assert len(held) > 80 and np.mean([found[i].predicted == truth[i] for i in held]) >= 0.97
    assert np.mean([found[i].predicted for i, _ in odd]) >= 0.9
    assert sum(found[i].predicted for i, _ in clean) <= 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert found[3000].score == found[3001].score == found[3002].score < 0.5
    assert found[None].predicted == 1 and not found[None].held_out


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(3, 250)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one = toxicity.train(*frames(spark, rows, labels))
    assert one == toxicity.train(*frames(spark, rows, turned)) and one.landmarks


def test_copies_of_a_toxic_text_teach_only_its_insults(spark):
    """A large group of near copies has many rare words in common; they must not count as insults."""
    rows, labels = corpus(4, 300)
    rng = random.Random(5)
    rare = [f"qu{a}x{b}vy" for a in "aeiou" for b in "aeiou"]
    base = " ".join([*rare, *prose(rng, 60).split(), "wazzock"])
    for i in range(5000, 5150):
        words = base.split()
        words[25 + rng.randrange(60)] = "edited"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, 1))
    clean = [(9000 + i, f"{prose(rng, 30)} {w} {prose(rng, 10)}") for i, w in enumerate(rare)]
    docs, marks = frames(spark, [*rows, *clean], labels)
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, marks).collect()}
    assert sum(found[i] for i, _ in clean) == 0
    assert sum(found[i] for i in range(5000, 5150)) == 150


def test_odd_labels_and_tables(spark):
    rows, labels = corpus(6, 200)
    # Labels repeat, contradict (toxic wins) or are null; rows repeat.
    more = [*labels, *labels[:30], *((i, q, None) for i, q, _ in labels[:20]), (None, 1, 1), (99_999, 1, 1)]
    docs, marks = frames(spark, [*rows, rows[0], rows[0]], more)
    assert toxicity.train(docs, marks).landmarks == toxicity.train(*frames(spark, rows, labels)).landmarks
    scores = toxicity.toxicity(docs, marks)
    assert scores.count() == len(rows) + 2
    for few in ([], [(i, q, 0) for i, q, _ in labels], [(i, q, 1) for i, q, _ in labels], [(None, 1, 1)]):
        out = toxicity.toxicity(*frames(spark, rows, few)).collect()
        assert len(out) == len(rows) and {r.score for r in out} == {0.0} and {r.predicted for r in out} == {0}
    assert toxicity.toxicity(*frames(spark, [], labels)).count() == 0


def test_long_texts_are_read_whole(spark):
    rows, labels = corpus(7, 300)
    rng = random.Random(8)
    filler = prose(rng, 200) + " "
    long = filler * 3000
    docs, marks = frames(spark, [*rows, (7000, long + "grimpet"), (7001, long), (7002, "x" * 300_000 + "wazzock" + "x" * 300_000)], labels)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert found[7000].predicted == 1 and found[7000].worst == "grimpet"
    assert found[7001].predicted == 0
    assert "wazz" in found[7002].worst
