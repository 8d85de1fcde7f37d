"""Tokenizers and fingerprints against the libraries and plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staylens.llm import pieces, simhash, sketches, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")

CLASH = "id int, value int, row int, token int, fp int, place int, run int, key int, wanted int"


def clashing(spark, rows, schema):
    extra = len(CLASH.split(","))
    return spark.createDataFrame([(*r, *range(extra)) for r in rows], f"{schema}, {CLASH}")


def made(seed, alphabet, count, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(count)]


TEXT = [
    "a", "b", "the", "ing", " ", "  ", "\n", "▁", "é", "é", "ß", "日", "😀", "0", "<s>", "</s>", "<unk>",
    "<0x41>", "\t", "A", "aaa", "...", "\x00", "�", "ﬁ", "\x1c", " ", "'s", "'LL", "<|endoftext|>", "<|",
    "İ", "Σ", "ς", "_", "x" * 90,
]
ROWS = [(None, None), (None, ""), (7, "a a"), (7, "a a")]


# -- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_ids_and_decoding_match_the_library(library):
    own = pieces.vocabulary(PIECES)
    for text in [*made(1, TEXT, 5000), "ab" * 50_000, "▁" * 300, " " * 1000 + "x"]:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text[:100]
        assert own.decode(got) == library.decode(want)


def test_decoding_of_any_ids(library):
    own, rng = pieces.vocabulary(PIECES), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 260), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    own = pieces.Vocabulary(PIECES)
    for text in made(3, TEXT, 50):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_round_trip_query(spark, library):
    texts = made(4, TEXT, 200)
    docs = clashing(spark, [*enumerate(texts), *ROWS], "doc_id long, text string")
    rows = pieces.round_trip(docs, PIECES).collect()
    want = Counter()
    for name, text in [*enumerate(texts), *ROWS]:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[name, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    both = pieces.decoded(pieces.encoded(docs, PIECES), PIECES)
    kept = Counter((r.doc_id, r.decoded) for r in both.collect())
    assert kept == Counter(
        (n, library.decode(library.encode(t or ""))) for n, t in [*enumerate(texts), *ROWS]
    )
    assert pieces.round_trip(docs.limit(0), PIECES).count() == 0


# -- token counts


@pytest.mark.parametrize("head", [token_counts.HEAD, 20, 0])
def test_counts_match_the_library(spark, head):
    library = Tokenizer.from_file(WORDS)
    texts = made(5, TEXT, 1500)
    rows = [*enumerate(texts), *ROWS]
    docs = clashing(spark, rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in token_counts.document_counts(docs, WORDS, head=head).collect())
    want = Counter(
        (n, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for n, t in rows
    )
    assert got == want


def test_plain_words_are_cut_as_by_the_library():
    cutter = token_counts.pre_tokens(WORDS)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)]] + list("''''sstrevmld́ſ")
    plain = 0
    for word in made(6, letters, 20_000, 8):
        if cutter.simple.fullmatch(word):
            plain += 1
            assert cutter._simply(word) == cutter._alone(word), word
    assert plain > 1000


def test_head_is_bounded(spark):
    counts = spark.createDataFrame([(f"t{i}", 1 + i // 10, 1) for i in range(500)], "token string, n long, pieces long")
    for most in (0, 1, 37, 499, 500):
        least = token_counts.head_threshold(counts, most)
        assert counts.filter(F.col("n") >= least).count() <= most


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.document_counts(docs, WORDS).count() == 0


# -- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    ordered = sorted(root)
    for i, one in enumerate(ordered):
        for other in ordered[:i]:
            if (one ^ other).bit_count() <= 2:
                a, b = find(one), find(other)
                root[max(a, b)] = min(a, b)
    return {f: find(f) for f in root}


def test_fingerprints_match_plain_python(monkeypatch):
    monkeypatch.setattr(simhash, "BATCH", 7)
    for text in [None, "", " \n", "One", "one two", *made(7, ["a ", "B ", "é ", "\x0b", "x"], 300, 80)]:
        raw = None if text is None else text.encode()
        assert simhash.fingerprint(raw) == plain_fingerprint(text)


def test_golay_code_is_perfect_and_keys_meet():
    golay, rng = simhash.Golay(), random.Random(8)
    assert len({*golay.errors.tolist()}) == 2048
    assert max(int(e).bit_count() for e in golay.errors) == 3
    words = np.array([rng.getrandbits(22) for _ in range(400)])
    for flips in range(3):
        other = words.copy()
        for i in range(len(other)):
            for bit in rng.sample(range(22), flips):
                other[i] ^= 1 << bit
        ours, theirs = golay.keys(words, 22)[0], golay.keys(other, 22)[0]
        assert all(set(a) & set(b) for a, b in zip(ours, theirs, strict=True))


def near_fingerprints(seed, families=12, members=30):
    """Families around a few centres, chains, lone ones and zero."""
    rng, found = random.Random(seed), {0, 1, (1 << 64) - 1}
    for _ in range(families):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, members)):
            found.add(fp)
            step = fp
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                step ^= 1 << bit
            found.add(step)
            fp = step if rng.random() < 0.5 else fp
    return sorted(found)


@pytest.mark.parametrize("bucket", [1, 3, simhash.BUCKET])
def test_components_match_brute_force(spark, bucket):
    fps = near_fingerprints(bucket)
    want = plain_components(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps * 2)]
    prints = spark.createDataFrame(rows, "id long, fp long")
    groups = {r.fp % (1 << 64): r.group_id for r in simhash.groups(prints, bucket).collect()}
    least = {}
    for i, f in enumerate(fps):
        least[want[f]] = min(i, least.get(want[f], i))
    assert groups == {f: least[want[f]] for f in fps}
    assert len(set(groups.values())) < len(fps)


def test_near_duplicates_rows(spark):
    rows = [(5, "a b c d"), (3, "A b C d"), (None, "a b c d"), (9, None), (8, ""), (8, " "), (4, "z y x w v")]
    docs = clashing(spark, rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fp = {t: f"{plain_fingerprint(t):016x}" for _, t in rows}
    assert got == {
        (5, fp["a b c d"], 3), (3, fp["a b c d"], 3), (None, fp["a b c d"], 3),
        (9, "0" * 16, 8), (8, "0" * 16, 8), (4, fp["z y x w v"], 4),
    }
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_per_group_keeps_one_row(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, None), (4, "z y x w v")]
    docs = clashing(spark, rows, "doc_id long, text string")
    out = simhash.one_per_group(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, "a b c d"), (None, None), (4, "z y x w v")], key=str)


# -- sketches


def shingles(text):
    words = (text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_short_texts_are_exact():
    for one, other in zip(made(9, ["a ", "b ", "c "], 100, 60), made(10, ["a ", "b ", "c "], 100, 60), strict=True):
        a, b = shingles(one), shingles(other)
        want = len(a & b) / len(a | b) if a and b else float(a == b)
        s, t = sketches.sketch(one.encode()), sketches.sketch(other.encode())
        assert sketches.resemblance(s, t) == pytest.approx(want)
        assert sketches.distinct_shingles(s) == len(a)
        assert sketches.containment(s, t) == pytest.approx(len(a & b) / len(a) if a else 1)


def test_estimates_on_long_texts():
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(20_000)]
    one, other = " ".join(words), " ".join(words[5000:] + [f"v{i}" for i in range(5000)])
    s, t = sketches.sketch(one.encode()), sketches.sketch(other.encode())
    assert abs(sketches.resemblance(s, t) - 0.6) < 0.15
    assert abs(sketches.containment(s, t) - 0.75) < 0.15
    assert abs(sketches.distinct_shingles(s) / len(shingles(one)) - 1) < 0.3


def test_parts_merge_to_the_whole(spark, monkeypatch):
    text = " ".join(f"w{i % 3000}" for i in range(9000))
    whole = sketches.sketch(text.encode())
    monkeypatch.setattr(sketches, "BATCH", 100)
    assert sketches.sketch(text.encode()).tolist() == whole.tolist()
    words = text.split()
    parts = [" ".join(words[i : i + 504]) for i in range(0, 9000, 500)]
    df = spark.createDataFrame([(1, p) for p in parts * 3] + [(2, ""), (2, None)], "doc_id long, text string")
    merged = {r.doc_id: r.fingerprint for r in sketches.merged_by(sketches.sketched(df), "doc_id").collect()}
    assert merged == {1: sketches.shown(whole), 2: ""}
    assert sketches.read(merged[1]).tolist() == whole.tolist()


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_beside_next_match_plain_python(spark, partitions):
    texts = made(12, ["a ", "b ", "日 ", "é", "\n"], 60, 120)
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)]
    rows += [(None, None), (None, "a b"), (3, "twice"), (3, "twice"), (3, "again"), (2**60 + 1, "x"), (2**60, "y")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = clashing(spark, rows, "doc_id long, text string")
        got = Counter(
            (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
            for r in sketches.beside_next(docs).collect()
        )
        assert sketches.beside_next(docs.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(((n is not None, n or 0, t or "") for n, t in rows))
    want = Counter()
    for i, (known, name, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][2]
        size = len(text) // 4
        changed = text[: len(text) - size] + after[:size]
        s, t, u = (sketches.sketch(x.encode()) for x in (text, changed, after))
        want[
            name if known else None, len(text), hashlib.sha256(changed.encode()).hexdigest(),
            sketches.shown(s), sketches.shown(t),
            round(sketches.resemblance(s, t), 9), round(sketches.resemblance(s, u), 9),
        ] += 1
    assert got == want
