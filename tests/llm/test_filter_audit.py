"""The filter audit against a count of every order in plain Python."""

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from staylens.llm import filter_audit

CLASH = ", ".join(f"{c} int" for c in ("id", "part", "fails", "number", "digest", "list", "good", "removed"))
COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plain_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in rows:
        if doc_id is not None:
            text = text or ""
            first[text] = min(doc_id, first.get(text, doc_id))
    for doc_id, quality, bad in labels:
        if doc_id is not None:
            good |= {doc_id} if quality == 1 else set()
            toxic |= {doc_id} if bad == 1 else set()
    parts = defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        words = text.encode().split()
        fails = "A" if len(words) < 50 else ""
        fails += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else ""
        fails += "D" if set(text) & set("#$%&*|") else ""
        fails += "E" if doc_id is not None and first[text] < doc_id else ""
        parts[source or ""].append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == f for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def documents(seed, n):
    rng = random.Random(seed)
    texts = ["", None, "a" * 100, "A " * 60, " ".join(f"w{i}" for i in range(80)) + " #", "é" * 5 + "A"]
    rows = []
    for i in range(n):
        words = [f"{rng.choice('abC')}{rng.randint(0, 60)}" for _ in range(rng.randint(30, 90))]
        text = rng.choice([*texts, *(r[1] for r in rows[-5:]), *[" ".join(words)] * 8])
        rows.append((i, text, rng.choice(["hot"] * 6 + ["", None, "x", "é"])))
    rng.shuffle(rows)
    return [*rows, rows[0], rows[0], (None, "a" * 100, "x"), (None, None, None), (n, "a b c " * 9, "alone")]


def labelled(seed, n):
    rng = random.Random(seed)
    rows = [(rng.randint(0, n + 9), rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for _ in range(n)]
    return [*rows, *rows[:9], (None, 1, 1)]


def run(spark, rows, labels):
    extra = len(CLASH.split(", "))
    docs = spark.createDataFrame(
        [(*r, *range(extra)) for r in rows], f"doc_id long, text string, source string, {CLASH}"
    )
    marks = spark.createDataFrame(
        [(*r, 0, 0) for r in labels], "doc_id long, quality int, toxic int, id int, text int"
    )
    out = filter_audit.audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *COLUMNS]
    found = out.collect()
    assert all(kind == "bigint" for name, kind in out.dtypes if name in COLUMNS)
    result = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in found}
    assert len(result) == len(found)
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order(spark, seed):
    rows, labels = documents(seed, 400), labelled(seed, 300)
    found = run(spark, rows, labels)
    assert len({k[0] for k in found}) * 600 == len(found)
    assert found == plain_audit(rows, labels)


def test_ranges_add_up(spark, monkeypatch):
    """Lists cut into many small ranges give the same sums."""
    rows, labels = documents(3, 300), labelled(3, 200)
    monkeypatch.setattr(filter_audit, "RANGE_BITS", 2)
    assert run(spark, rows, labels) == plain_audit(rows, labels)


def test_no_documents_and_no_labels(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    rows = documents(4, 30)
    assert run(spark, rows, []) == plain_audit(rows, [])
    clean = [(1, " ".join(f"w{i}" for i in range(80)), "s")]
    assert set(run(spark, clean, []).values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_merges_equal_sets():
    rng = random.Random(5)
    for _ in range(200):
        lists = [
            np.array(sorted(rng.sample(range(200), rng.choice([0, 1, 5, 120]))), dtype=np.int64)
            for _ in range(rng.randint(0, 5))
        ]
        union = set().union(*(set(x.tolist()) for x in lists))
        assert filter_audit.merged(lists).tolist() == sorted(union)
        for ids in lists:
            for other in lists:
                assert filter_audit.held(ids, other).tolist() == [x in set(other.tolist()) for x in ids]


@pytest.mark.parametrize("text", [b"", b" \x0b\x0c", "é 中 a a".encode(), b"a" * 50, b"\x1c\x85 \xc2\xa0 x"])
def test_long_texts_are_cut_alike(text, monkeypatch):
    short = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "LONG", 0)
    assert filter_audit.word_counts(text) == short
