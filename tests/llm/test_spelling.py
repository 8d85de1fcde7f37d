"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staylens.llm import spelling
from staylens.session import staged

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)
CLASH = ", ".join(f"{c} int" for c in ("id", "word", "n", "run", "node", "prefix", "best", "root"))


def plain_words(rows, least, count):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def near(one, other):
    if len(one) > len(other):
        one, other = other, one
    if len(one) == len(other):
        return sum(a != b for a, b in zip(one, other, strict=True)) == 1
    return len(one) + 1 == len(other) and any(one == other[:i] + other[i + 1 :] for i in range(len(other)))


def plain_variants(words, ratio):
    form, many = {}, {}
    for w in words:
        close = [v for v in words if near(v, w)]
        many[w] = len(close)
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], many[w], words.get(form[w])))
    return rows


def found_rows(out):
    assert dict(out.dtypes) == dict(
        word="string", form="string", root="string", n="bigint", n_near="bigint", form_n="bigint"
    )
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def frame(spark, rows):
    clash = CLASH.split(", ")
    return spark.createDataFrame([(*r, *range(len(clash))) for r in rows], f"doc_id long, text string, {CLASH}")


def corpus(seed, letters, longest, texts):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(40)]
    rows = []
    for i in range(texts):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = list(stems[min(39, int(rng.expovariate(0.15)))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(letters)], [w[at], rng.choice(letters)]])
            words.append("".join(w))
        rows.append((i, rng.choice([" ", ", ", "-", "1", "ß÷", "中"]).join(words)))
    return [*rows, (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (9, None), (10, ""), (11, "ABCDEF abcdef ÀBCDEF")]


@pytest.mark.parametrize("seed,letters,longest", [(1, "ab", 12), (2, "aé", 7), (3, "abcABC", 9), (4, "aàÿÞ", 8)])
def test_all_pairs(spark, seed, letters, longest):
    rows = corpus(seed, letters, longest, 120)
    for least, count in ((6, 5), (1, 2)):
        words = plain_words(rows, least, count)
        assert len(words) >= 10
        out = spelling.variants(frame(spark, rows), least=least, count=count)
        assert found_rows(out) == plain_variants(words, 5)


def test_chain_of_forms(spark):
    rows = [(i, "zzzzzz") for i in range(5)]
    rows += [(1000 + i, "zzzzzy") for i in range(30)] + [(2000, "zzzzyy " * 200), (3000, "zzzyyy " * 1500)]
    out = {r.word: r for r in spelling.variants(frame(spark, rows)).collect()}
    words = plain_words(rows, 6, 5)
    assert {r.root for r in out.values()} == {"zzzyyy"}
    assert {(w, r.form, r.root, r.n, r.n_near, r.form_n) for w, r in out.items()} == plain_variants(words, 5)


def test_one_word_near_very_many(spark):
    """A third of all words share one place; each still finds all others."""
    letters = [chr(c) for c in range(0xC0, 0x100)] + [chr(c) for c in range(ord("a"), ord("z") + 1)]
    rows = [(i, f"centr{x}l") for i, x in enumerate(letters)] * 6
    words = plain_words(rows, 6, 5)
    assert found_rows(spelling.variants(frame(spark, rows))) == plain_variants(words, 5)


def test_very_long_words(spark):
    long = "ab" * 2000
    rows = [(1, f"{long} " * 30), (2, f"{long}b " * 5), (3, (long[:2999] + "x" + long[3000:] + " ") * 6)]
    words = plain_words(rows, 6, 5)
    assert len(words) == 3
    assert found_rows(spelling.variants(frame(spark, rows))) == plain_variants(words, 5)


def test_nodes_are_not_broadcast(spark):
    """Spark sizes the nodes by the words they are made from; at any size both sides of a join shuffle."""
    rows = [(i, "centre centra central centrale") for i in range(20)]
    words = staged(
        spelling.word_counts(frame(spark, rows)).withColumn("id", F.monotonically_increasing_id()), "words"
    )
    forms = staged(spelling.with_forms(words), "forms")
    for out in (spelling.numbered_paths(words), spelling.with_forms(words), spelling.roots(forms), spelling.variants(frame(spark, rows))):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan
    assert found_rows(out) == plain_variants(plain_words(rows, 6, 5), 5)


def test_no_words(spark):
    assert found_rows(spelling.variants(frame(spark, []))) == set()
    assert found_rows(spelling.variants(frame(spark, [(1, None), (2, "a b c"), (3, "sixlet" * 4)]))) == set()


def test_keys_tell_paths_apart():
    words = ["a" * n for n in (1, 63, 64, 65, 128, 129, 200)] + ["a" * 64 + "b" * n for n in (1, 64, 65)]
    paths = {}
    for w in words:
        keys = spelling.path_keys(w)
        assert len(keys) == len(set(keys)) == len(w)
        for i, key in enumerate(keys, 1):
            assert paths.setdefault(key, w[:i]) == w[:i]
    assert len(paths) == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_query_matches_brute_force(spark):
    """The registered query over a folder of its own, with the production parameters."""
    from staylens.llm.queries import QUERIES
    from staylens.session import fresh_path

    folder = fresh_path(spark, "tables")
    rows = corpus(7, "abc", 9, 300)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    found = found_rows(QUERIES["op11_spelling_variants"](spark, folder))
    assert found == plain_variants(plain_words(rows, 6, 5), 5)
