"""Best unrated items against brute force over all pairs; ids of any kind."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_plans import plan_of

from staylens.operators import best_items, id_book, recommender
from staylens.session import staged


def made_model(spark, users, items):
    """What a fitted model offers: two tables of factors."""
    schema = "id int, features array<float>"
    return SimpleNamespace(
        userFactors=spark.createDataFrame(sorted(users.items()), schema),
        itemFactors=spark.createDataFrame(sorted(items.items()), schema),
    )


def factors(rng, rank, scale):
    # Sums of few binary fractions: many exact ties.
    return [rng.randint(-4, 4) * scale for _ in range(rank)]


def brute_force(users, items, rated, k):
    rows = set()
    for u, own in users.items():
        scores = sorted(
            (-sum(a * b for a, b in zip(own, other, strict=True)), i)
            for i, other in items.items()
            if (u, i) not in rated
        )
        rows |= {(u, i, -s, place) for place, (s, i) in enumerate(scores[:k], 1)}
    return rows


@pytest.mark.parametrize("seed,first,largest", [(1, 32, 128), (2, 64, 64), (3, 1024, 65_536)])
def test_equal_to_all_pairs(spark, seed, first, largest):
    rng = random.Random(seed)
    users = {u: factors(rng, 3, 0.25) for u in range(1, 60)} | {60: [0.0] * 3, 61: [-2.0] * 3}
    items = {i: factors(rng, 3, rng.choice([0.125, 0.5, 2.0])) for i in range(300)}
    rated = {(rng.randint(1, 70), rng.randrange(300)) for _ in range(900)}
    # One user has rated half of all items, one all, one all but two.
    rated |= {(5, i) for i in range(0, 300, 2)} | {(6, i) for i in range(300)} | {(7, i) for i in range(298)}
    rows = spark.createDataFrame([(u, i, 1.0) for u, i in [*rated, *list(rated)[:20]]], "user int, item int, rating double")
    model = made_model(spark, users, items)
    wanted = spark.createDataFrame([(u,) for u in [*users, 5, 999, None]], "user long")
    out = best_items.best_unrated(rows, model, wanted, 5, first, largest)
    found = [(r.user, r.item, r.prediction, r.place) for r in out.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_force(users, items, rated, 5)
    assert not [r for r in found if r[0] == 6] and len([r for r in found if r[0] == 7]) == 2


def test_long_factors_end_the_search(spark, monkeypatch):
    """Where the first block holds what cannot be reached, later blocks meet no user."""
    users = {u: [1.0, 0.5] for u in range(1, 50)}
    items = {i: [100.0, 100.0] if i < 20 else [2.0**-10, 2.0**-10] for i in range(2000)}
    rated = {(1, i) for i in range(1000)}
    rows = spark.createDataFrame([(u, i, 1.0) for u, i in rated], "user int, item int, rating double")
    met = []
    scored = best_items._scored

    def counted(open_users, *rest):
        met.append(open_users.count())
        return scored(open_users, *rest)

    monkeypatch.setattr(best_items, "_scored", counted)
    wanted = spark.createDataFrame([(u,) for u in users], "user int")
    out = best_items.best_unrated(rows, made_model(spark, users, items), wanted, 10, 64, 256)
    found = {(r.user, r.item, r.prediction, r.place) for r in out.collect()}
    assert found == brute_force(users, items, rated, 10)
    # The user with half of all ratings goes on alone.
    assert met[0] == 49 and set(met[1:]) == {1}


def test_no_users_or_items(spark):
    none = spark.createDataFrame([], "user int, item int, rating double")
    model = made_model(spark, {1: [1.0]}, {})
    assert best_items.best_unrated(none, model, spark.createDataFrame([(1,)], "user int"), 3).count() == 0
    model = made_model(spark, {1: [1.0]}, {2: [1.0]})
    assert best_items.best_unrated(none, model, spark.createDataFrame([], "user int"), 3).count() == 0


def test_plan_has_no_product(spark):
    users, items = {1: [1.0], 2: [2.0]}, {1: [1.0], 2: [3.0]}
    rows = spark.createDataFrame([(1, 1, 1.0)], "user int, item int, rating double")
    out = best_items.best_unrated(rows, made_model(spark, users, items), rows.select("user"), 1)
    assert "NestedLoop" not in plan_of(out) and out.count() == 1


# -- numbers for ids


def test_order_is_numbered_without_gaps(spark):
    rng = random.Random(4)
    values = [rng.choice([None, *range(50)]) for _ in range(500)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(7)
    out = id_book.in_order(rows, F.desc_nulls_last("v"), "i", start=10).orderBy("place").collect()
    assert [r.place for r in out] == list(range(10, 510))
    keys = [(r.v is None, -(r.v or 0), r.i) for r in out]
    assert keys == sorted(keys)
    assert id_book.in_order(rows.limit(0), "v").count() == 0


@pytest.mark.parametrize("kind,make", [("string", lambda n: f"ü{n}"), ("long", lambda n: n * 10**12)])
def test_books_grow_and_keep_numbers(spark, kind, make):
    frame = lambda ns: spark.createDataFrame([(make(n),) for n in ns] + [(None,)] * 3, f"who {kind}")
    one = id_book.grown_book(frame([5, 1, 3, 3, 1]), "who")
    first = {r.id: r.number for r in one.collect()}
    assert sorted(first.values()) == [0, 1, 2] and first == {make(n): i for i, n in enumerate([1, 3, 5])}
    two = id_book.grown_book(frame([4, 0, 3]), "who", one)
    second = {r.id: r.number for r in two.collect()}
    assert second == first | {make(0): 3, make(4): 4}
    assert {r.id: r.number for r in id_book.grown_book(frame([1]), "who", two).collect()} == second
    back = id_book.with_ids(two.select(F.col("number").alias("n")), "n", two, "who")
    assert {(r.who, r.n) for r in back.collect()} == set(second.items())


def rated(spark, users, items, name):
    rng = random.Random(9)
    rows = [(name(u), 10**13 + i, float(rng.randint(1, 5))) for u in users for i in items if rng.random() < 0.6]
    return spark.createDataFrame(rows, "user string, item long, rating double")


def test_any_ids_train_predict_and_recommend(spark):
    name = lambda u: f"guest-{u}"
    ratings = staged(rated(spark, range(30), range(20), name), "ratings")
    found = recommender.train_with_ids(ratings, rank=4, iterations=3)
    out = recommender.predict_with_ids(found, ratings)
    assert out.columns == ["user", "item", "rating", "prediction"]
    assert out.count() == ratings.count() and out.exceptAll(out.filter("prediction is not null")).isEmpty()
    unseen = spark.createDataFrame([("nobody", 10**13), (None, 10**13), (name(1), 5)], "user string, item long")
    assert recommender.predict_with_ids(found, unseen).count() == 0
    best = recommender.recommend_with_ids(found, ratings, ratings.select("user"), 3)
    assert best.join(ratings, ["user", "item"]).isEmpty()
    rows = best.collect()
    assert {r.user for r in rows} <= {name(u) for u in range(30)} and {r.place for r in rows} == {1, 2, 3}
    again = {(r.user, r.item): r.prediction for r in recommender.predict_with_ids(found, best.select("user", "item")).collect()}
    assert all(again[r.user, r.item] == pytest.approx(r.prediction, rel=1e-4) for r in rows)


def test_numbers_stay_when_ratings_arrive(spark):
    name = lambda u: f"guest-{u:03d}"
    one = recommender.train_with_ids(rated(spark, range(10, 30), range(15), name), rank=2, iterations=2)
    more = rated(spark, range(40), range(25), name)
    two = recommender.train_with_ids(more, one.users, one.items, rank=2, iterations=2)
    for before, after in ((one.users, two.users), (one.items, two.items)):
        old, new = ({r.id: r.number for r in book.collect()} for book in (before, after))
        assert old.items() <= new.items() and len(new) > len(old)
        assert sorted(new.values()) == list(range(len(new)))
    assert recommender.predict_with_ids(two, more).count() == more.count()
