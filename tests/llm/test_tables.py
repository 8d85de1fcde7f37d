"""Mixing, web archives, chat windows and the pipeline on small tables, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from staylens.llm import chat, mixing, queries, simhash, warc
from staylens.session import fresh_path, staged

CLASH = "id int, queue int, row int, size int, copies int, key int, times int, record int, window int"


def clashing(spark, rows, schema):
    extra = len(CLASH.split(","))
    return spark.createDataFrame([(*r, *range(extra)) for r in rows], f"{schema}, {CLASH}")


# -- mixing


def weights(sources):
    return mixing.code_point_weights(sources, (5, 2, 1))


def plain_targets(sizes, budget):
    """Share by weight, stop at three times the size, share the excess anew."""
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    ordered += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    target, fixed = {}, set()
    while True:
        open_ = [s for s in ordered if s not in fixed]
        rest = budget - sum(3 * sizes[s] for s in fixed)
        for s in ordered:
            target[s] = 3 * sizes[s] if s in fixed else rest * weight[s] / sum(weight[x] for x in open_)
        above = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not above:
            return target
        fixed.update(above)


def mix_rows(seed):
    rng = random.Random(seed)
    sources = ["é", "z", "a", None, "Z", "", "tiny"]
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(sources[:6]), "en") for i in range(600)]
    rows += [(i, "w " * 9, "big", "en") for i in range(900)]
    return [*rows, (7, "w w", "tiny", "en"), (7, "w w", "tiny", "en"), (None, None, None, None), (None, "w", None, None)]


def test_mix_meets_its_targets(spark):
    rows = mix_rows(1)
    docs = clashing(spark, rows, "doc_id long, text string, source string, lang string")
    out = mixing.mixed(docs, weights).collect()
    assert len(out) == len(rows)
    sizes, longest = Counter(), Counter()
    for _, text, source, _ in rows:
        n = len((text or "").split())
        sizes[source] += n
        longest[source] = max(longest[source], n)
    target = plain_targets(sizes, sum(sizes.values()))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    # What sources lack of their targets, less than a document each, goes to those that come next.
    for source in sizes:
        assert -longest[source] <= taken[source] - target[source] <= 2 * max(longest.values()), source
    assert sum(taken.values()) <= sum(sizes.values())


def test_mix_reruns_agree(spark):
    docs = spark.createDataFrame(mix_rows(2), "doc_id long, text string, source string, lang string")
    one = Counter(tuple(r) for r in mixing.mixed(docs, weights).collect())
    other = Counter(tuple(r) for r in mixing.mixed(docs.repartition(5), weights).collect())
    assert one == other


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(docs, weights).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.copies) for r in mixing.mixed(blank, weights).collect()] == [(0, 0.0, 0)] * 2


def test_repeated_rows_are_whole(spark):
    docs = clashing(spark, mix_rows(3), "doc_id long, text string, source string, lang string")
    out = mixing.repeated(docs, weights)
    assert out.columns == docs.columns
    kept = Counter(tuple(r) for r in out.collect())
    there = Counter(tuple(r) for r in docs.collect())
    assert all(there[k] * 3 >= n > 0 for k, n in kept.items())
    words = sum(len(k[1].split()) * n for k, n in kept.items())
    sizes = [len((r.text or "").split()) for r in docs.collect()]
    assert sum(sizes) - max(sizes) <= words <= sum(sizes)


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = {r.i: r.upto for r in mixing.running_totals(df, "g", ["i"], "v").collect()}
    total, want = Counter(), {}
    for g, i, v in rows:
        total[g] += v
        want[i] = total[g]
    assert got == want


# -- web archives


def captures(rows, spark):
    path = fresh_path(spark, "archives")
    warc.write_archives(rows, path)
    return warc.merged_index(warc.read_captures(spark, path)).collect()


def expected(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    found = Counter()
    for payload, pages in groups.items():
        pages.sort(key=lambda p: (p is not None, p or 0))
        for i, page in enumerate(pages):
            last = len(payload) < 1000 or i == len(pages) - 1
            digest = hashlib.sha1(payload).hexdigest()
            kind = "response" if last else "revisit"
            found[page, len(payload), digest, kind, None if last else pages[-1]] += 1
    return found


def test_archives_round_trip(spark):
    trap = "ö\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [
        (1, "http://B.example.com/b", "x" * 1500), (5, "http://a/b\r\nX: 1", "x" * 1500), (5, "u", "x" * 1500),
        (None, None, "x" * 1500), (None, None, None), (7, "é", trap), (8, "", trap), (9, "q", "short"),
        (10, "q", "short"), (-3, "z", ""), (11, "long", "日" * 400_000), (12, "k", "y" * 999), (13, "k", "y" * 999),
    ]
    rows += [(100 + i, "http://hot.example.com/", "<p>" * 400) for i in range(200)]
    found = captures(clashing(spark, rows, "page_id long, url string, html string"), spark)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    assert got == expected(rows)
    keys = [(r.url_key, r.captured_at) for r in found]
    assert keys == sorted(keys)
    assert any(k == "com,example,b)/b" for k, _ in keys)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert captures(pages, spark) == []


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(5)
    for count in range(10):
        runs = [sorted((rng.randint(0, 9), i) for _ in range(rng.randint(0, 6))) for i in range(count)]
        assert list(warc.merge_runs(runs, key=lambda r: r)) == sorted(sum(runs, []))


# -- chat

PARTS = ["a ", "b", "\\", "\n", "<turn>", "</turn>", "<again>", "<", "/turn>", "turn>", "\\n", "n", "é", "😀", "assistant\n", " word" * 9]
ROLES = ["user", "assistant", "system", "user", "assistant", "", "a\nb", "a\\", "\\n", "<turn>", None, "x\\\n"]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 25)):
            text = rng.choice([None, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))])
            rows.append((conv or None, rng.choice([turn, turn, None, turn - 1]), rng.choice(ROLES), text))
    return rows + rows[:3]


def plain_digests(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = {}
    for conv, turns in groups.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        found[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


def digests(windows):
    rows = chat.read_back(windows).collect()
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("budget,history", [(2048, 512), (120, 30), (40, 10), (1, 0)])
def test_windows_read_back(spark, budget, history):
    rows = conversations(budget)
    windows = staged(chat.windows(clashing(spark, rows, "conv_id long, turn long, role string, text string"), budget, history), "w")
    assert digests(windows) == plain_digests(rows)
    # Only a window whose room is less than its system turn or single turn needs may exceed it.
    over = windows.filter((F.col("tokens") > budget) & (F.col("n_own") > 2))
    assert over.count() == 0 or budget < 120


def test_control_strings_and_limits(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], queries.ODD_TEXT + f" {i}") for i in range(2000)]
    rows.append((1, -1, "system", "be brief"))
    windows = staged(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 50), "w")
    assert digests(windows) == plain_digests(rows)
    stats = windows.agg(F.max("tokens"), F.min("tokens"), F.count("*")).first()
    assert stats[0] <= 200 and stats[2] > 50
    first = windows.orderBy("window").first().formatted
    assert first.startswith("<turn>system\nbe brief</turn>\n")
    later = windows.filter("window > 0").select("formatted").collect()
    assert all(r.formatted.startswith("<again>system\nbe brief</turn>\n<again>") for r in later)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(empty)).count() == 0


# -- pipeline


def test_pipeline_matches_brute_force(spark):
    """Each stage's effect worked out in plain Python from what the stage before it kept."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("st", "nd", "ple", "ing", "er")]

    def prose(n):
        return " ".join(rng.choice([*words, "the", "of", "and"]) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(n))

    rows = [(i, prose(rng.randint(60, 200)), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s9", 0) for i in range(20)]
    rows += [(200, "junk", "en", "s1", 0), (201, "# $ " * 100, "en", "s1", 0), (202, None, None, None, None)]
    rows += [(300, prose(80) + " password=hunter2hunter2 " + prose(5), "en", None, 0)]
    rows = [(i, t, g, s, len(t) if t else None) for i, t, g, s, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    texts = {i: t for i, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, staged(stage(spark, kept, ""), "stage")
        ids = {r.doc_id for r in kept.collect()}
        was = {r.doc_id for r in before.collect()}
        if "SentencePiece" not in name:
            assert kept.columns == docs.columns
        if "quality" in name:
            assert was - ids == {200, 201, 202}
        elif "SimHash" in name:
            fp = {i: simhash.fingerprint(texts[i].encode()) for i in was}
            near = [(i, j) for i in was for j in was if i < j and (fp[i] ^ fp[j]).bit_count() <= 2]
            assert all(not (i in ids and j in ids) for i, j in near)
            assert was - ids == {j for _, j in near}
        elif "secret" in name:
            assert ids == was
            changed = [r for r in kept.collect() if r.text != texts[r.doc_id]]
            assert [r.doc_id for r in changed] == [300] and "hunter2" not in changed[0].text
            assert changed[0].n_chars == len(changed[0].text)
        elif "mixing" in name:
            assert ids <= was and kept.groupBy("doc_id").count().filter("count > 3").count() == 0
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in kept.collect():
        if r.doc_id != 300:
            assert list(r.ids) == model.encode(texts[r.doc_id], add_bos=True, add_eos=True)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
