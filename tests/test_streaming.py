"""The streamed scores equal the batch ones."""

from pyspark.sql import functions as F

from staylens.plans import flows
from staylens.session import fresh_path
from staylens.sources import standins
from staylens.streaming.scoring import score_stream

FOLDER = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    model = flows.train_value_model(
        standins.places(spark, FOLDER), standins.hotels(spark, FOLDER),
        standins.leads(spark, FOLDER), k=4,
    )
    searches = standins.searches(spark, FOLDER).dropDuplicates(["search_id"])
    batch = flows.score_searches(searches, model.support, model.forest)
    source, sink = fresh_path(spark, "search-stream"), fresh_path(spark, "scores")
    arriving = searches.withColumn("seen_at", F.lit("2018-01-01 10:00:00").cast("timestamp"))
    arriving.union(arriving.limit(50)).write.parquet(source)
    stream = spark.readStream.schema(arriving.schema).parquet(source)
    query = (
        score_stream(stream, model.support, model.forest, "seen_at")
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.parquet(sink).select(*batch.columns)
    assert found.count() == batch.count() > 0
    assert found.exceptAll(batch).isEmpty()
