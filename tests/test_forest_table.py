"""The forest as a table and as SQL against the fitted forest."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_hotels import training_rows

from staylens.operators import forest, forest_table
from staylens.session import staged


@pytest.fixture(scope="module")
def fitted(spark):
    rows = staged(training_rows(spark, 3000).filter("rating < 13 and tot_themes < 14"), "forest-rows")
    model = forest.train_forest(rows)
    return rows, model, forest_table.forest_nodes(spark, model)


def both(one, other):
    again = other.select("lead_id", F.col("prediction").alias("p"), F.col("probability").alias("q"))
    return one.join(again, "lead_id").select("prediction", "p", "probability", "q").collect()


def test_sql_scores_as_the_forest(spark, fitted):
    rows, model, nodes = fitted
    compiled = forest_table.forest_sql(nodes)
    scored = forest_table.score_sql(compiled, rows, "lead")
    assert scored.columns == forest.score(model, rows, "lead").columns
    found = both(forest.score(model, rows, "lead"), scored)
    assert len(found) == rows.count()
    assert all(r.prediction == r.p and r.probability == pytest.approx(r.q, abs=1e-12) for r in found)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "udf" not in plan.lower() and "Python" not in plan and "Vector" not in plan
    assert plan.count("Project") <= 3 and "Exchange" not in plan


def test_the_same_text_runs_elsewhere(spark, fitted):
    rows, model, nodes = fitted
    compiled = forest_table.forest_sql(nodes)
    inputs = forest.prepared(rows, "lead").toPandas()  # noqa: F841
    found = duckdb.sql(f"SELECT lead_id, {compiled.prediction} AS p, {compiled.probability} AS q FROM inputs").fetchall()
    expected = {r.lead_id: r for r in forest.score(model, rows, "lead").collect()}
    assert len(found) == len(expected)
    for lead, p, q in found:
        assert p == expected[lead].prediction and q == pytest.approx(expected[lead].probability, abs=1e-12)


def test_walking_the_table_scores_as_the_forest(spark, fitted):
    rows, model, nodes = fitted
    ready = forest.prepared(rows, "lead").select("lead_id", *forest.model_inputs("lead").values())
    walked = forest_table.walk(nodes, ready, ["lead_id"], forest.DEPTH)
    found = both(forest.score(model, rows, "lead"), walked)
    assert len(found) == rows.count()
    assert all(r.prediction == r.p and r.probability == pytest.approx(r.q, abs=1e-12) for r in found)


def test_table_of_nodes(spark, fitted):
    _, model, nodes = fitted
    rows = nodes.collect()
    by_key = {(r.tree, r.node): r for r in rows}
    assert len(by_key) == len(rows) == sum(t.numNodes for t in model.stages[-1].trees)
    inner = [r for r in rows if r.feature is not None]
    assert inner and any(r.categories for r in inner) and any(r.threshold is not None for r in inner)
    for r in inner:
        left, right = by_key[r.tree, r.left], by_key[r.tree, r.right]
        assert [a + b for a, b in zip(left.votes, right.votes, strict=True)] == r.votes
        assert (r.threshold is None) != (r.categories is None) and r.gain > 0
        assert r.feature in forest.model_inputs("lead").values()
    assert all(r.left is r.right is r.threshold is r.categories is None for r in rows if r.feature is None)


def test_importances_follow_from_the_table(spark, fitted):
    _, model, nodes = fitted
    found = {r.feature: r.importance for r in forest_table.importances(nodes).collect()}
    stated = {r.feature: r.importance for r in forest.describe_forest(spark, model).collect()}
    assert found.keys() == stated.keys()
    assert all(found[f] == pytest.approx(stated[f], abs=1e-12) for f in found)


def test_nulls_ties_and_empty_tables(spark, fitted):
    rows, model, nodes = fitted
    compiled = forest_table.forest_sql(nodes)
    names = [c for c in rows.columns if c not in ("lead_id", "hotel_id", "gooddeal")]
    blank = rows.limit(3).withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in names})
    one, other = (f.collect() for f in (forest.score(model, blank, "lead"), forest_table.score_sql(compiled, blank, "lead")))
    assert [(r.prediction, r.probability) for r in one] == [(r.prediction, pytest.approx(r.probability)) for r in other]
    assert forest_table.score_sql(compiled, rows.limit(0), "lead").count() == 0
    # As many votes for either class: class 0, as the fitted forest says.
    even = forest_table.ForestSql(("0.5e0 + 0.5e0", "0.5e0 + 0.5e0"))
    tied = forest_table.score_sql(even, rows.limit(1), "lead").first()
    assert (tied.prediction, tied.probability) == (0, 0.5)


def test_outside_a_category_still_fails(spark, fitted):
    _, _, nodes = fitted
    wild = training_rows(spark, 30)
    with pytest.raises(Exception, match="is outside 0"):
        forest_table.score_sql(forest_table.forest_sql(nodes), wild, "lead").collect()


def test_a_forest_of_single_leaves(spark):
    """Labels that are all alike leave trees without a division."""
    rows = training_rows(spark, 60).filter("rating < 13 and tot_themes < 14").withColumn("gooddeal", F.lit(1))
    model = forest.train_forest(rows)
    nodes = forest_table.forest_nodes(spark, model)
    scored = forest_table.score_sql(forest_table.forest_sql(nodes), rows, "lead")
    assert {(r.prediction, r.probability) for r in scored.collect()} == {
        (r.prediction, r.probability) for r in forest.score(model, rows, "lead").collect()
    }
    assert {r.importance for r in forest_table.importances(nodes).collect()} == {0.0}


def test_walking_moves_nothing(spark, fitted):
    """All trees are walked on the row: no join, no copy of a row for each tree, equal ids stay apart."""
    rows, _, nodes = fitted
    ready = forest.prepared(rows, "lead").select("lead_id", *forest.model_inputs("lead").values())
    twice = ready.unionByName(ready)
    walked = forest_table.walk(nodes, twice, ["lead_id"], forest.DEPTH)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Join", "Exchange", "Generate", "Aggregate"))
    assert walked.count() == 2 * rows.count()


def test_fitting_holds_few_rows_in_a_task(spark):
    """A matrix in one task's files is read by as many tasks as its rows ask for; the setting is put back."""
    name = "spark.sql.files.minPartitionNum"
    one = spark.range(1000).repartition(1)
    table = staged(one, "fit-rows", rows_per_file=50)
    before = spark.conf.get(name, None)
    with forest._cut_finer(spark, 20):
        sizes = table.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 1000 and max(sizes) <= 50
    assert spark.conf.get(name, None) == before
