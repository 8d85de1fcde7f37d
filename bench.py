"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each query runs once untimed
on the smallest tables, so that start-up of the JVM and of Python workers is not measured, and is
then timed from its call to the last row of its whole result.
"""

from __future__ import annotations

import json
import os
import time

from staylens.plans import flows
from staylens.plans.catalogue import QUERIES
from staylens.plans.value_queries import HOTELS_PER_CLUSTER
from staylens.session import build_session
from staylens.sources import standins

HEADLINE = [
    "search_features",
    "hotel_features",
    "support_table",
    "search_support_join",
    "value_label",
    "rowwise_zscore",
    "kmeans_clusters",
    "kmeans_cost",
    "bisecting_clusters",
    "rf_train_score",
    "score_search",
    "als_predict",
    "als_rank_search",
    "complete_ratings",
    "recommend_items",
    "top_k_items",
    "user_vectors",
    "content_text",
    "tfidf_long",
    "feature_pivot",
    "hashed_tfidf",
    "user_feature_affinity",
]


def fit_and_score(spark, folder: str) -> dict[str, float]:
    """The value model in its two parts: training the whole flow, and scoring all searches with it."""
    start = time.perf_counter()
    model = flows.train_value_model(
        standins.places(spark, folder),
        standins.hotels(spark, folder),
        standins.leads(spark, folder),
        hotels_per_cluster=HOTELS_PER_CLUSTER,
    )
    fitted = time.perf_counter()
    scored = flows.score_searches(standins.searches(spark, folder), model.support, model.compiled)
    scored.write.format("noop").mode("overwrite").save()
    return {"value_model_fit": fitted - start, "value_model_score": time.perf_counter() - fitted}


def run(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("staylens-bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            run(name, spark, warm)
    times = {name: round(run(name, spark, folder), 3) for name in HEADLINE}
    times |= {name: round(took, 3) for name, took in fit_and_score(spark, folder).items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
