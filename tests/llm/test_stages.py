"""The stages of the pipeline on odd tables, and what they share."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staylens.llm import common, simhash, stages, warc
from staylens.session import fresh_path, staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", ".join(f"{c} int" for c in ("key", "wanted", "id", "fp", "row", "dirty", "spans", "blob", "size"))


def odd_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("st", "nd", "ple", "er")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    for i in range(60, 140):
        # Copies, with letters in another case or with a word replaced far inside a long text.
        words = texts[rng.randrange(60)].split()
        if rng.random() < 0.5 and len(words) > 60:
            words[rng.randrange(len(words))] = "zz"
        text = " ".join(words) if rng.random() < 0.7 else " ".join(words).upper()
        rows.append((i, text, None, None, None))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, None, "en", "s1", None)]
    rows += [(None, texts[0], "en", "x", 1), (None, "only here and in no other row", "en", "x", 1)] * 2
    rows += [rows[3], rows[3], (3, texts[3] + " ", "de", "y", 9), (300, "long word " * 30_000, "en", "s2", 1)]
    rng.shuffle(rows)
    return rows


def near_groups(rows):
    """Rows by group: fingerprints of at most two differing bits are linked."""
    prints = sorted({simhash.fingerprint((r[1] or "").encode()) for r in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for r in rows:
        groups.setdefault(find(simhash.fingerprint((r[1] or "").encode())), []).append(r)
    return list(groups.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_group_stays(spark, seed):
    rows = odd_rows(seed)
    extra = len(CLASH.split(", "))
    docs = spark.createDataFrame([(*r, *range(extra)) for r in rows], f"{SCHEMA}, {CLASH}")
    out = stages.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    kept = [tuple(r)[:5] for r in out.collect()]
    groups = near_groups(rows)
    assert len(kept) == len(groups) < len(rows)
    for group in groups:
        held = [r for r in kept if r in group]
        ids = [r[0] for r in group if r[0] is not None]
        assert len(held) == 1 and held[0][0] == (min(ids) if ids else None)


def test_stages_on_odd_rows(spark):
    extra = len(CLASH.split(", "))
    rng = random.Random(9)
    nouns = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("st", "nd", "ple", "ing", "er")]
    prose = [
        " ".join(rng.choice([*nouns, "the", "of", "and"]) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(150))
        for _ in range(20)
    ]
    rows = [*odd_rows(3), *((i, t, None, None, None) for i, t in enumerate(prose, 600)), (None, prose[0] + " x", "en", "s", 1)]
    kept = spark.createDataFrame([(*r, *range(extra)) for r in rows], f"{SCHEMA}, {CLASH}")
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = staged(stage(spark, kept, ""), "odd")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == before.columns, name
    assert kept.count() > 0


def test_stages_without_rows(spark):
    kept = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        kept = staged(stage(spark, kept, ""), "none")
        assert kept.count() == 0, name
    folder = fresh_path(spark, "tables")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_row_keys_tell_rows_apart(spark):
    rows = [("a\x1f=b", "c"), ("a", "b\x1f=c"), ("a", None), (None, "a"), ("1=a", ""), ("", "1=a"), ("-", None), (None, "-"), (None, None), ("", "")]
    frame = spark.createDataFrame(rows, "x string, y string")
    keys = [r.k for r in frame.select(common.row_key(frame).alias("k")).collect()]
    assert len(set(keys)) == len(rows)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_capture_times_do_not_depend_on_the_zone(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moments = [0, 86_399, 1_704_067_200, 1_710_054_000, 4_102_444_799]
        pages = spark.createDataFrame([(i, f"http://h/{i}", "x", m) for i, m in enumerate(moments)], "page_id long, url string, html string, at long")
        path = fresh_path(spark, "archives")
        warc.write_archives(pages, path, F.timestamp_seconds("at"))
        back = warc.read_captures(spark, path).select("page_id", F.unix_seconds("captured_at").alias("at")).collect()
        assert {r.page_id: r["at"] for r in back} == dict(enumerate(moments))
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
