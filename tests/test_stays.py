"""Searches and leads: hand-computed rows, quirks included."""

import pytest
from pyspark.sql import functions as F

from staylens import schemas
from staylens.functions import stay
from staylens.operators import cleaning, stays
from staylens.sources import files

# id, date, check_in, check_out, rooms, total, nb_rooms
ROWS = [
    ("s1", "2018-01-01", "2018-02-10", "2018-02-12", "2:4,6|1", 400.0, 2),
    ("s2", "2018-01-01", "2018-02-10", "2018-02-11", "3:", 350.0, 1),
    ("s3", "2018-01-01", "2018-02-10", "2018-02-10", "2", 200.0, 1),
    ("s4", "2018-01-01", "2018-02-10", "2018-02-12", None, 200.0, 1),
    ("s5", "2018-01-01", "2018-02-10", "2018-02-12", "2", None, 1),
    ("s6", "2018-13-01", "2018-03-01", "2018-03-03", "2", 200.0, 1),
]
SCHEMA = (
    "search_id string, date string, check_in string, check_out string, "
    "room_description string, total_usd double, nb_rooms int"
)


@pytest.fixture(scope="module")
def searches(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("hotel_id", F.lit(16777217).cast("long"))


def by_id(df, *columns):
    return {row["search_id"]: tuple(row[c] for c in columns) for row in df.collect()}


def test_features_of_golden_rows(searches):
    found = by_id(
        stays.search_features(searches), "checkin_month", "search_month", "searchdays", "effUSD"
    )
    assert found == {
        "s1": (2, 1, 40, 25.0),
        "s2": (2, 1, 40, 100.0),
        "s3": (2, 1, 40, 0.0),
        "s5": (2, 1, 40, 0.0),
        "s6": (3, 0, 0, 50.0),
    }


def test_large_hotel_ids_stay_exact(searches):
    ids = {row["hotel_id"] for row in stays.search_features(searches).collect()}
    assert ids == {16777217}


def test_guests_and_nights(searches):
    full = stays.room_guests(stays.timeline_features(searches, "search"))
    assert by_id(full, "bookdays", "tot_guests") == {
        "s1": (2, 4.0), "s2": (1, 3.5), "s3": (0, 2.0), "s5": (2, 2.0), "s6": (2, 2.0),
    }


def test_price_valid_tells_missing_from_zero(searches):
    full = stays.room_guests(stays.timeline_features(searches, "search"))
    priced = by_id(stays.effective_price(full), "effUSD", "price_valid")
    assert priced["s3"] == (0.0, False)
    assert priced["s5"] == (0.0, False)
    assert priced["s1"] == (25.0, True)


@pytest.mark.parametrize(
    ("text", "blank_is_zero", "expected"),
    [
        ("2:4,6|1", False, (3.0, 2)),
        ("3:", False, (3.0, 1)),
        ("3:", True, (3.0, 0)),
        ("3", False, (3.0, 0)),
        ("x:1", False, (None, 1)),
        ("x|2", False, (2.0, 0)),
        ("", False, (None, 0)),
        ("1:2:3,4", False, (1.0, 1)),
    ],
)
def test_guest_totals(spark, text, blank_is_zero, expected):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(stay.guest_totals(F.col("t"), blank_is_zero).alias("g")).first()["g"]
    assert (row["adults"], row["kids"]) == expected


def test_leads_use_the_same_rules(searches):
    leads = searches.withColumnRenamed("search_id", "lead_id")
    found = stays.lead_features(leads)
    assert found.columns == [
        "lead_id", "hotel_id", "checkin_month", "lead_month", "leaddays", "effUSD",
    ]
    assert found.count() == 5


def test_a_lead_sampled_twice_counts_once(searches):
    twice = searches.union(searches)
    assert stays.search_features(twice).count() == 5
    assert stays.search_features(twice, dedupe=False).count() == 10


def test_lenient_dates(spark):
    df = spark.createDataFrame(
        [("2018-1-5",), ("2018",), ("2018-01-05 10:11",), ("05/01/2018",)], "d string"
    )
    days = [str(r[0]) for r in df.select(stay.as_day(F.col("d"))).collect()]
    assert days == ["2018-01-05", "2018-01-01", "2018-01-05", "None"]


def test_headed_scan_finds_columns_by_name(spark, tmp_path):
    (tmp_path / "search.csv").write_text(
        "extra,hotel_id,search_id,usersearch_id,date,check_in,check_out,room_description,"
        "total_usd,nb_rooms\n"
        "x,7,a,u,2018-1-5,2018-02-01,,2:3|1,12.5,two\n"
    )
    row = files.read_headed_csv(spark, str(tmp_path / "search.csv"), schemas.SEARCH).first()
    assert (row["search_id"], row["hotel_id"], row["total_usd"]) == ("a", 7, 12.5)
    assert str(row["date"]) == "2018-01-05"
    assert row["check_out"] is None and row["nb_rooms"] is None


def test_headerless_scan_names_by_position(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("10,1,4.5\n20,1,bad\n")
    rows = files.read_headerless_csv(spark, str(tmp_path / "ratings.csv"), schemas.RATINGS)
    found = sorted((r["item"], r["user"], r["rating"]) for r in rows.collect())
    assert found == [(10, 1, 4.5), (20, 1, None)]


def test_fill_leaves_text_and_ids(spark):
    df = spark.createDataFrame([(None, None, None)], "id bigint, name string, n int")
    assert cleaning.fill_numeric(df, keep=("id",)).first() == (None, None, 0)


def test_one_row_per_is_independent_of_order(spark):
    rows = [(1, "b", 2), (1, "a", 9), (2, "c", 1), (1, "a", 9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id int, name string, n int")
        found = sorted(map(tuple, cleaning.one_row_per(df, "id").collect()))
        assert found == [(1, "a", 9), (2, "c", 1)]


def test_hash_split_depends_on_the_key_alone(spark):
    ids = spark.range(2000).withColumn("x", F.rand(1))
    first = {r["id"]: r["split"] for r in cleaning.hash_split(ids, ["id"]).collect()}
    moved = ids.repartition(5).orderBy("x")
    again = {r["id"]: r["split"] for r in cleaning.hash_split(moved, ["id"]).collect()}
    assert first == again
    share = sum(s == "train" for s in first.values()) / len(first)
    assert 0.66 < share < 0.74
    other = {r["id"]: r["split"] for r in cleaning.hash_split(ids, ["id"], seed=3).collect()}
    assert other != first


def test_sample_with_replacement_can_repeat(spark):
    found = [r[0] for r in cleaning.sample_rows(spark.range(1000), 0.9, 0, True).collect()]
    assert len(found) > len(set(found))
    once = [r[0] for r in cleaning.sample_rows(spark.range(1000), 0.5, 0).collect()]
    assert len(once) == len(set(once))
