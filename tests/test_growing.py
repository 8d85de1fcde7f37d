"""Stores that grow: cluster means by day, TF-IDF by batch; and what CSV input loses."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_hotels import HOTEL_SCHEMA, LEAD_SCHEMA, grouped, lead

from staylens.operators import content, value, value_partials
from staylens.operators.content_ledger import ContentLedger
from staylens.schemas import SEARCH
from staylens.session import staged
from staylens.sources import files


def day_leads(spark, seed, days, hot=3):
    """Leads over some days, a third of them of one hotel."""
    rng = random.Random(seed)
    rows = []
    for d in days:
        for n in range(30):
            hotel = hot if n % 3 == 0 else rng.randint(1, 12)
            rows.append((*lead(f"{seed}-{d}-{n}", hotel, rng.choice([None, round(rng.uniform(5, 90), 2)])), date(2024, 1, 1) + timedelta(d)))
    return spark.createDataFrame(rows, f"{LEAD_SCHEMA}, day date")


def labels_of(rows):
    return {r.lead_id: (r.cluster_id, pytest.approx(r.meanUSD), r.gooddeal) for r in rows.collect()}


def test_labels_from_stored_days(spark, tmp_path):
    path = str(tmp_path / "sums")
    first, second = staged(day_leads(spark, 1, range(4)), "leads"), staged(day_leads(spark, 2, range(4, 6)), "leads")
    late = staged(day_leads(spark, 3, [2]).unionByName(first.filter("day = '2024-01-03'")), "leads")
    hotels = spark.createDataFrame([grouped(h, h % 4) for h in range(1, 13)], HOTEL_SCHEMA)
    value_partials.store_days(first, "day", path)
    value_partials.store_days(second, "day", path)
    value_partials.store_days(late, "day", path)  # the third day again, with late leads
    all_leads = first.filter("day <> '2024-01-03'").unionByName(second).unionByName(late)
    sums = value_partials.stored_days(spark, path)
    for regrouped in (hotels, hotels.withColumn("cluster_id", F.col("hotel_id") % 3)):
        found = value_partials.label_by_sums(second.drop("day"), regrouped, sums)
        full = value.value_label(all_leads.drop("day"), regrouped)
        expected = labels_of(full)
        got = {r.lead_id: (r.cluster_id, r.meanUSD, r.gooddeal) for r in found.collect()}
        assert len(got) == second.count()
        assert all(got[k] == expected[k] for k in got)
        assert found.columns == full.columns
    one_day = sums.filter("period = '2024-01-05'")
    assert "PartitionFilters: [isnotnull(period" in one_day._jdf.queryExecution().executedPlan().toString()
    assert one_day.agg(F.sum("leads")).first()[0] == second.filter("day = '2024-01-05' and effUSD is not null").count()


def test_months_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "sums")
    leads = staged(day_leads(spark, 5, range(20, 45)), "leads")
    value_partials.store_days(leads, "day", path, period="month")
    value_partials.store_days(leads.filter("month(day) = 2"), "day", path, period="month")
    sums = value_partials.stored_days(spark, path)
    assert sorted(str(r.period) for r in sums.select("period").distinct().collect()) == ["2024-01-01", "2024-02-01"]
    expected = rows_of(value_partials.day_sums(leads, "day"), "day", "hotel_id", "leads")
    assert rows_of(sums, "day", "hotel_id", "leads") == expected


def words(rng, n):
    return " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", f"rare{rng.randint(0, 40)}"]) for _ in range(n))


def rows_of(table, *columns):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in table.select(*columns).collect())


def test_weights_after_appends_equal_a_full_run(spark, tmp_path):
    rng = random.Random(1)
    ledger = ContentLedger(spark, str(tmp_path / "ledger"), spark.range(1).schema["id"].dataType)
    batches = [
        [(i, words(rng, rng.randint(0, 12))) for i in range(30)],
        [(i, words(rng, 8)) for i in range(30, 40)] + [(3, "new words ab"), (4, None), (5, "")],
        [(i, words(rng, 5)) for i in range(40, 45)] + [(3, "ab ab other"), (31, "cd")],
    ]
    now = {}
    for n, batch in enumerate(batches):
        ledger.append(spark.createDataFrame(batch, "item long, text string"), n)
        now |= dict(batch)
        full = staged(spark.createDataFrame(list(now.items()), "item long, text string"), "content")
        assert rows_of(ledger.idf(), "feature", "df", "idf") == rows_of(content.idf(full), "feature", "df", "idf")
        columns = "item", "feature", "tf", "tfidf"
        assert rows_of(ledger.tfidf(), *columns) == rows_of(content.tfidf_long(full), *columns)
    # A batch written again changes nothing.
    before = rows_of(ledger.tfidf(), "item", "feature", "tf", "tfidf")
    ledger.append(spark.createDataFrame(batches[2], "item long, text string"), 2)
    assert rows_of(ledger.tfidf(), "item", "feature", "tf", "tfidf") == before


def test_weights_read_no_texts(spark, tmp_path):
    ledger = ContentLedger(spark, str(tmp_path / "ledger"), spark.range(1).schema["id"].dataType)
    ledger.append(spark.createDataFrame([(1, "a b"), (2, "b c")], "item long, text string"), 0)
    weights = ledger.tfidf()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "Generate" not in plan
    tables = {f.split("/ledger/")[1].split("/")[0] for f in weights.inputFiles()}
    assert tables == {"items", "terms", "frequency"}
    # An append reads the new texts once and of the old items their words alone.
    new = staged(spark.createDataFrame([(2, "c d")], "item long, text string"), "new-items")
    ledger.append(new, 1)
    assert rows_of(ledger.idf(), "feature", "df") == {("a", 1): 1, ("b", 1): 1, ("c", 1): 1, ("d", 1): 1}


CSV = """search_id,usersearch_id,hotel_id,date,check_in,check_out,room_description,total_usd,nb_rooms
s1,u1,7,2018-01-01,2018-02-10,2018-02-12,2:4,400.5,2
s2,u1,seven,2018-13-01,2018-02-10,2018-02-12,2,12x,1
s3,u2,8,2018-1-5,,2018-02-12,,,two
s4,u2,9,2018-01-01
s5,u2,9,2018-01-01,2018-02-10,2018-02-12,2,1.0,1,extra,fields
s6,u3,99999999999999999999,2018-01-01,2018-02-30,2018-02-12,"a,b",nan,1
"""


def test_lost_fields_are_told(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(CSV)
    (folder / "b.csv").write_text(CSV.split("\n")[0] + "\ns7,u3,x,2018-01-01,2018-02-10,2018-02-12,2,1.0,1\n")
    rows, rejects = files.read_headed_csv_checked(spark, str(folder), SEARCH)
    found = rejects.collect()
    by_column = Counter(r.column for r in found)
    assert by_column == {"hotel_id": 3, "date": 1, "check_in": 1, "total_usd": 1, "nb_rooms": 1, None: 2}
    assert {r.value for r in found if r.column == "hotel_id"} == {"seven", "99999999999999999999", "x"}
    assert sorted(r.value.split(",")[0] for r in found if r.column is None) == ["s4", "s5"]
    assert {r.reason for r in found if r.column in ("date", None)} == {"date", "number of fields"}
    assert {r.file.rsplit("/", 1)[1] for r in found if r.value == "x"} == {"b.csv"}
    in_file = [r.row for r in sorted(found, key=lambda r: r.row) if r.file.endswith("a.csv")]
    assert in_file == sorted(in_file)
    plain = files.read_headed_csv(spark, str(folder / "b.csv"), SEARCH)
    assert rows.columns == plain.columns and rows.count() == 7
    assert rows.filter("search_id = 's7'").exceptAll(plain).isEmpty()
    again = rows.filter("search_id = 's3'").first()
    assert str(again.date) == "2018-01-05" and again.check_in is None and again.nb_rooms is None


def test_lost_fields_without_a_header(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("1,2,3.5\nx,2,4\n3,4\n5,6,\n7,8,1e400,9\n")
    schema = spark.createDataFrame([], "item int, user int, rating double").schema
    rows, rejects = files.read_headerless_csv_checked(spark, str(path), schema)
    assert rows.count() == 5
    assert Counter(r.column for r in rejects.collect()) == {"item": 1, None: 2}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    rows, rejects = files.read_headerless_csv_checked(spark, str(tmp_path / "none"), schema)
    assert rows.count() == rejects.count() == 0
