"""Registered queries on stores that grow and on what CSV input loses."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import stays, value, value_partials
from staylens.operators.content_ledger import ContentLedger
from staylens.plans import oracle_parts as parts
from staylens.plans.booking_queries import support
from staylens.plans.registry import query, rounded
from staylens.schemas import HOTEL
from staylens.session import fresh_path, staged
from staylens.sources import files, standins

# Batches in which the items arrive, and the share of hotels whose popularity cannot be read.
BATCHES = 3
UNREADABLE = 10


@query(
    "stored_day_labels",
    f"""WITH {parts.LABELLED}
SELECT * EXCLUDE ("meanUSD"), round("meanUSD", 6) AS "meanUSD" FROM labelled""",
)
def stored_day_labels(spark, folder):
    """The labels of all leads, from sums stored by day in a folder a month; every other month comes later."""
    leads = staged(stays.lead_features(standins.leads(spark, folder), ids=("date",)), "day-leads")
    path = fresh_path(spark, "day-sums")
    later = F.coalesce(F.month("date") % 2 == 0, F.lit(False))
    for part in (~later, later):
        value_partials.store_days(leads.filter(part), "date", path, period="month")
    hotels = value.clustered_hotels(support(spark, folder), standins.brand_clusters(spark, folder))
    labelled = value_partials.label_by_sums(leads, hotels, value_partials.stored_days(spark, path))
    return rounded(labelled, 6, "meanUSD")


@query(
    "grown_tfidf",
    f"WITH {parts.TFIDF} SELECT item, feature, tf, round(tfidf, 6) AS tfidf FROM tfidf",
)
def grown_tfidf(spark, folder):
    """The weights of all words after the items came in batches, each batch with old versions of the next one's."""
    content = standins.content(spark, folder).select("item", "text")
    kind = content.schema["item"].dataType
    ledger = ContentLedger(spark, fresh_path(spark, "content-ledger"), kind)
    batch = F.pmod(F.xxhash64("item"), F.lit(BATCHES))
    for n in range(BATCHES):
        older = content.filter(batch == n + 1).withColumn("text", F.lit("an older version"))
        ledger.append(content.filter(batch == n).unionByName(older), n)
    return rounded(ledger.tfidf(), 6, "tfidf")


@query(
    "csv_rejects",
    f"""WITH {parts.HOTEL_RAW}
SELECT 'popularity' AS "column", 'double' AS reason, count(*) AS fields
FROM hotel_raw WHERE hotel_id % {UNREADABLE} = 0 AND popularity IS NOT NULL""",
)
def csv_rejects(spark, folder):
    """Fields that a scan of hotels could not take, of which the popularity of one in ten is no number."""
    path = fresh_path(spark, "odd-hotel-csv")
    hotels = standins.hotels(spark, folder)
    odd = (F.col("hotel_id") % UNREADABLE == 0) & F.col("popularity").isNotNull()
    files.write_csv(hotels.withColumn("popularity", F.when(odd, "n/a").otherwise(F.col("popularity").cast("string"))), path)
    _, rejects = files.read_headed_csv_checked(spark, path, HOTEL)
    return rejects.groupBy("column", "reason").agg(F.count("*").alias("fields"))
