"""Random forest that tells good value from the rest."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.operators.value import matrix_features

# The inputs that are categories, with the number of their values.
CATEGORIES = {"checkin_month": 13, "asked_month": 13, "rating": 13, "tot_themes": 14}

# Training parameters.
TREES = 4
DEPTH = 7
BINS = 15
SUBSET = "auto"
IMPURITY = "gini"

# Rows that one task of a pass should hold.
FIT_ROWS = 200_000


def model_inputs(kind: str) -> dict[str, str]:
    """Matrix column -> model input. Search and lead columns share one name in the model."""
    shared = {f"{kind}_month": "asked_month", f"{kind}days": "asked_days"}
    return {c: shared.get(c, c) for c in matrix_features(kind)}


def prepared(
    df: DataFrame,
    kind: str,
    categories: dict[str, int] | None = None,
    out_of_range: str = "error",
) -> DataFrame:
    """Inputs as doubles under their model names, categories marked as such.

    A forest takes categories 0..n-1 only. With ``out_of_range="error"`` any other value fails the
    query; with ``"numeric"`` all inputs are plain numbers and no value is altered. The choice must
    be the same in training and scoring. Pass other ``categories`` to widen their ranges;
    ``out_of_range_counts`` counts what lies outside.
    """
    if out_of_range not in ("error", "numeric"):
        raise ValueError("out_of_range is 'error' or 'numeric'")
    categories = CATEGORIES if categories is None else categories
    if out_of_range == "numeric":
        categories = {}
    inputs = model_inputs(kind)
    columns = [F.col(c) for c in df.columns if c not in inputs]
    for source, name in inputs.items():
        value = F.coalesce(F.col(source).cast("double"), F.lit(0.0))
        if name not in categories:
            columns.append(value.alias(name))
            continue
        arity = categories[name]
        whole = F.floor(value).cast("double")
        problem = F.concat(F.lit(f"{name} is outside 0..{arity - 1}: "), value.cast("string"))
        inside = F.when((value >= 0) & (value < arity), whole).otherwise(
            F.raise_error(problem).cast("double")
        )
        mark = {"ml_attr": {"type": "nominal", "name": name, "num_vals": arity}}
        columns.append(inside.alias(name, metadata=mark))
    return df.select(*columns)


def out_of_range_counts(df: DataFrame, kind: str) -> DataFrame:
    """One row: how many values of each category lie outside its range."""
    counts = []
    for source, name in model_inputs(kind).items():
        if name in CATEGORIES:
            value = F.floor(F.col(source))
            bad = (value < 0) | (value >= CATEGORIES[name])
            counts.append(F.count_if(bad).alias(name))
    return df.agg(*counts)


@contextmanager
def _cut_finer(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Files read inside are cut into ``tasks`` parts at least, or into whole row groups."""
    name = "spark.sql.files.minPartitionNum"
    own = spark.conf.get(name, None)
    spark.conf.set(name, str(max(tasks, int(own or 0), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def train_forest(
    matrix: DataFrame,
    kind: str = "lead",
    seed: int = 1,
    categories: dict[str, int] | None = None,
    out_of_range: str = "error",
) -> PipelineModel:
    """Fit the forest on a train matrix.

    Each pass reads the rows as Spark keeps them unpacked, many times the size of their files; so files are cut
    into tasks by rows, ``FIT_ROWS`` of the matrix in each, and not by bytes.
    """
    inputs = list(model_inputs(kind).values())
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        RandomForestClassifier(
            labelCol="label",
            numTrees=TREES,
            maxDepth=DEPTH,
            maxBins=BINS,
            impurity=IMPURITY,
            featureSubsetStrategy=SUBSET,
            seed=seed,
        ),
    ]
    rows = prepared(matrix, kind, categories, out_of_range)
    rows = rows.withColumn("label", F.col("gooddeal").cast("double"))
    with _cut_finer(matrix.sparkSession, -(-matrix.count() // FIT_ROWS)):
        return Pipeline(stages=stages).fit(rows.select("label", *inputs))


def score(
    model: PipelineModel,
    matrix: DataFrame,
    kind: str,
    categories: dict[str, int] | None = None,
    out_of_range: str = "error",
) -> DataFrame:
    """Each row's ids (and label, if it has one) with the prediction and its probability."""
    kept = [c for c in matrix.columns if c not in model_inputs(kind)]
    scored = model.transform(prepared(matrix, kind, categories, out_of_range))
    return scored.select(
        *kept,
        F.col("prediction").cast("int").alias("prediction"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("probability"),
    )


def error_rate(scored: DataFrame, label: str = "gooddeal", guess: str = "prediction") -> DataFrame:
    """One row: the share of rows whose guess is not the label."""
    wrong = (F.col(label) != F.col(guess)).cast("int")
    return scored.agg(F.avg(wrong).alias("test_error"), F.count("*").alias("rows"))


def mispredicted(
    scored: DataFrame, label: str = "gooddeal", guess: str = "prediction"
) -> DataFrame:
    return scored.filter(F.col(label) != F.col(guess))


def describe_forest(
    spark: SparkSession, model: PipelineModel, kind: str = "lead"
) -> DataFrame:
    """The weight of each input in the fitted forest."""
    forest = model.stages[-1]
    names = list(model_inputs(kind).values())
    rows = [(n, float(w)) for n, w in zip(names, forest.featureImportances.toArray(), strict=True)]
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]
    )
    return spark.createDataFrame(rows, schema)


def forest_text(model: PipelineModel) -> str:
    """The trees written out."""
    return model.stages[-1].toDebugString
