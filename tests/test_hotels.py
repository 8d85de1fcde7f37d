"""Hotels, support table, clusters and labels."""

import math

import pytest
from pyspark.sql import functions as F

from staylens import schemas
from staylens.operators import clusters, forest, hotels, scaling, value
from staylens.plans import flows
from staylens.sources import files

NONE8 = [None] * 8


def hotel(hotel_id, themes, facilities, ratings, reviews, place_id=1):
    # ratings: cleanliness, service, facilities, location, pricing, rooms, dining, overall
    return (hotel_id, place_id, themes, facilities, 3, reviews, 2, *ratings, 5.0, 80.0, None)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        hotel(1, "1|2|0|x", "3", [8.0, 8.0, 8.0, 8.0, 10.0, 8.0, 8.0, 8.0], 10),
        hotel(2, None, "5|6", [None] * 7 + [7.0], 4),
        hotel(3, None, None, NONE8, None),
    ]
    return spark.createDataFrame(rows, schemas.HOTEL)


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(1, 4, 10.0, 20.0, 2.0)], schemas.PLACE)


def test_golden_hotels(raw):
    found = {
        r["hotel_id"]: (r["tot_themes"], r["tot_facilities"], r["mean_rating"], r["effrat"])
        for r in hotels.hotel_features(raw).collect()
    }
    assert found == {1: (2, 1, 8.0, 80.0), 2: (None, 2, 1.0, 4.0), 3: (None, None, 0.0, None)}


def test_repeated_hotel_rows_count_once(raw):
    assert hotels.hotel_features(raw.union(raw)).count() == 3


def test_any_token_counts_text_too(raw):
    row = hotels.token_counts(raw, any_token=True).filter("hotel_id = 1").first()
    assert row["tot_themes"] == 4


def test_outer_joins_keep_missing_counts(raw):
    counts = hotels.outer_counts(hotels.facility_counts(raw), hotels.theme_counts(raw))
    assert {r["hotel_id"] for r in counts.collect()} == {1, 2}
    assert hotels.counts_onto_hotels(counts, raw.select("hotel_id")).count() == 3


def test_support_table_survives_its_sink(spark, raw, places, tmp_path):
    table = hotels.support_table(places, raw)
    path = str(tmp_path / "support")
    files.write_table(table, path)
    back = files.read_table(spark, path).select(*table.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    assert set(hotels.SUPPORT_COLUMNS) <= set(table.columns)


def test_row_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 4.0, 4.0, 4.0)], "id int, a double, b double, c double")
    found = {r["id"]: (r["z_a"], r["z_b"], r["z_c"]) for r in scaling.rowwise_zscore(df, ["a", "b", "c"]).collect()}
    assert found[1] == pytest.approx((-1.224745, 0.0, 1.224745), abs=1e-6)
    assert found[2] == (0.0, 0.0, 0.0)


def test_column_scores(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    found = sorted((r["z_a"], r["z_b"]) for r in scaling.column_zscore(df, ["a", "b"]).collect())
    assert [a for a, _ in found] == pytest.approx([-1.224745, 0.0, 1.224745], abs=1e-6)
    assert {b for _, b in found} == {0.0}
    with pytest.raises(ValueError):
        scaling.zscore(df, ["a"], axis="diagonal")


LEAD_SCHEMA = (
    "lead_id string, hotel_id bigint, checkin_month int, lead_month int, leaddays int, effUSD double"
)
HOTEL_SCHEMA = (
    "hotel_id bigint, effrat double, rating int, popularity double, property_type int, "
    "place_type_id int, rank double, tot_facilities bigint, tot_themes bigint, cluster_id int"
)


def lead(lead_id, hotel_id, price):
    return (lead_id, hotel_id, 1, 1, 10, price)


def grouped(hotel_id, cluster_id):
    return (hotel_id, 1.0, 1, 1.0, 1, 1, 1.0, 1, 1, cluster_id)


def test_golden_labels(spark):
    leads = spark.createDataFrame(
        [lead("a", 1, 10.0), lead("b", 1, 20.0), lead("c", 2, 30.0), lead("d", 3, 0.0)],
        LEAD_SCHEMA,
    )
    hotel_rows = spark.createDataFrame([grouped(1, 1), grouped(2, 1), grouped(3, 2)], HOTEL_SCHEMA)
    for order in (leads, leads.orderBy(F.desc("lead_id"))):
        labelled = value.value_label(order, hotel_rows)
        found = {r["lead_id"]: (r["meanUSD"], r["gooddeal"]) for r in labelled.collect()}
        assert found == {"a": (20.0, 1), "b": (20.0, 1), "c": (20.0, 0), "d": (0.0, 1)}


def test_train_matrix_has_twelve_inputs_and_a_label(spark):
    leads = spark.createDataFrame([lead("a", 1, 10.0)], LEAD_SCHEMA)
    hotel_rows = spark.createDataFrame(
        [(1, None, 1, 1.0, 1, 1, 1.0, None, None, 5)], HOTEL_SCHEMA
    )
    matrix = value.train_matrix(value.value_label(leads, hotel_rows))
    assert len(matrix.columns) == 2 + 12 + 1
    row = matrix.first()
    assert (row["effrat"], row["tot_themes"], row["gooddeal"]) == (0.0, 0, 1)


def cloud(spark, rows=240):
    """Three well separated groups of points."""
    ids = spark.range(rows).withColumn("g", F.col("id") % 3)
    noise = F.rand(7) - 0.5
    return ids.select("id", "g", (F.col("g") * 100 + noise).alias("x"), (F.col("g") * -50 + noise).alias("y"))


def test_clusters_keep_ids_and_find_groups(spark):
    points = cloud(spark)
    model = clusters.train_clusters(points, ["x", "y"], k=6, seed=3)
    assigned = clusters.assign_clusters(model, points, ["x", "y"])
    assert assigned.count() == 240 and assigned.select("id").distinct().count() == 240
    mixed = assigned.groupBy("cluster_id").agg(F.countDistinct("g").alias("n")).filter("n > 1")
    centres = clusters.model_centres(spark, model, ["x", "y"])
    cost = clusters.cluster_cost(assigned, centres, ["x", "y"]).first()
    assert cost["points"] == 240
    assert cost["sum_squared"] == pytest.approx(model.summary.trainingCost, rel=1e-6)
    if mixed.isEmpty():
        assert cost["sum_distance"] < 240


def test_cost_of_given_clusters(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0), (1, 6.0, 8.0), (2, 1.0, 1.0)], "cluster_id int, x double, y double"
    )
    cost = clusters.cluster_cost(df, clusters.given_centres(df, ["x", "y"]), ["x", "y"]).first()
    assert (cost["sum_distance"], cost["sum_squared"], cost["points"]) == (10.0, 50.0, 3)


def test_saved_clusters_give_the_same_groups(spark, tmp_path):
    from pyspark.ml.clustering import KMeansModel

    points = cloud(spark)
    model = clusters.train_clusters(points, ["x", "y"], k=3)
    path = str(tmp_path / "kmeans")
    files.save_model(model, path)
    before = clusters.assign_clusters(model, points, ["x", "y"]).select("id", "cluster_id")
    after = clusters.assign_clusters(KMeansModel.load(path), points, ["x", "y"])
    assert before.exceptAll(after.select("id", "cluster_id")).isEmpty()


def training_rows(spark, rows=600):
    """Label follows the price; other inputs are noise, some outside their category range."""
    n = F.col("id")
    return spark.range(rows).select(
        n.cast("string").alias("lead_id"), (n % 17).alias("hotel_id"),
        (n % 13).cast("int").alias("checkin_month"), (n % 12).cast("int").alias("lead_month"),
        (n % 90).cast("int").alias("leaddays"), (n % 100).cast("double").alias("effUSD"),
        (n % 7).cast("double").alias("effrat"), (n % 15).cast("int").alias("rating"),
        (n % 5).cast("double").alias("popularity"), (n % 3).cast("int").alias("property_type"),
        (n % 4).cast("int").alias("place_type_id"), (n % 6).cast("double").alias("rank"),
        (n % 9).alias("tot_facilities"), (n % 20).alias("tot_themes"),
        F.when(n % 100 < 40, 1).otherwise(0).alias("gooddeal"),
    )


def test_forest_learns_keeps_ids_and_survives_saving(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = training_rows(spark)
    model = forest.train_forest(rows, out_of_range="numeric")
    scored = forest.score(model, rows, "lead", out_of_range="numeric")
    assert scored.columns == ["lead_id", "hotel_id", "gooddeal", "prediction", "probability"]
    error = forest.error_rate(scored).first()
    assert error["rows"] == 600 and error["test_error"] < 0.2
    assert forest.mispredicted(scored).count() == round(error["test_error"] * 600)
    path = str(tmp_path / "forest")
    files.save_model(model, path)
    again = forest.score(PipelineModel.load(path), rows, "lead", out_of_range="numeric")
    assert scored.exceptAll(again).isEmpty()
    assert "Tree 3" in forest.forest_text(model)
    weights = {r["feature"]: r["importance"] for r in forest.describe_forest(spark, model).collect()}
    assert math.isclose(sum(weights.values()), 1.0, rel_tol=1e-6)
    assert max(weights, key=weights.get) == "effUSD"


def test_category_marks_and_range(spark):
    rows = training_rows(spark)
    ready = forest.prepared(rows, "lead")
    mark = ready.schema["rating"].metadata["ml_attr"]
    assert (mark["type"], mark["num_vals"]) == ("nominal", 13)
    with pytest.raises(Exception, match="is outside 0..12"):
        ready.agg(F.max("rating")).first()
    inside = forest.prepared(rows.filter("rating between 0 and 12"), "lead")
    assert inside.agg(F.max("rating")).first() == (12.0,)
    plain = forest.prepared(rows, "lead", out_of_range="numeric")
    assert plain.agg(F.max("rating")).first() == (14.0,)
    assert "ml_attr" not in plain.schema["rating"].metadata
    outside = forest.out_of_range_counts(rows, "lead").first()
    assert outside["rating"] == rows.filter("rating > 12").count() > 0
    assert outside["checkin_month"] == 0
    free = forest.prepared(rows, "lead", categories={})
    assert free.agg(F.max("rating")).first() == (14.0,)


def test_search_and_lead_columns_share_model_inputs():
    assert list(forest.model_inputs("search").values()) == list(forest.model_inputs("lead").values())


def test_whole_flow_scores_every_known_search(spark):
    from staylens.sources import standins

    folder = "/root/testdata/sf0.001"
    model = flows.train_value_model(
        standins.places(spark, folder), standins.hotels(spark, folder),
        standins.leads(spark, folder), k=8,
    )
    searches = standins.searches(spark, folder)
    scored = flows.score_searches(searches, model.support, model.compiled)
    fitted = flows.score_searches(searches, model.support, model.forest)
    assert scored.columns == fitted.columns
    one, other = (s.withColumn("probability", F.round("probability", 9)) for s in (scored, fitted))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    known = searches.filter("room_description is not null")
    assert scored.select("search_id").distinct().count() == known.select("search_id").distinct().count()
    error = forest.error_rate(model.held_out).first()["test_error"]
    share = model.held_out.agg(F.avg("gooddeal")).first()[0]
    assert error < min(share, 1 - share)


def test_training_leaves_only_what_it_returns(spark):
    from pathlib import Path

    from staylens.session import shared_folder
    from staylens.sources import standins

    folder = "/root/testdata/sf0.001"
    written = Path(shared_folder(spark).removeprefix("file:")) / "staylens"
    before = set(written.iterdir()) if written.exists() else set()
    model = flows.train_value_model(
        standins.places(spark, folder), standins.hotels(spark, folder),
        standins.leads(spark, folder), k=8,
    )
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(written.iterdir()) - before)
    assert left == ["cluster-tree", "support", "train-matrix"]
    assert model.held_out.count() > 0 and model.support.count() > 0
    assert model.clusters.leaves().count() > 4
