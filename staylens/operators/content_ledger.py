"""TF-IDF that grows: new items change the weights without old texts being split again.

A ledger is a folder with three tables, to which every batch of items adds a folder of its own:

``items``      (item): the items of the batch
``terms``      (item, feature, tf): their word counts
``frequency``  (feature, items): how many items more, or fewer, have the word

An item that comes again replaces its former version: the new batch takes the former version's words out of
``frequency``, which it finds among the stored word counts by item. So the number of items with a word is the sum
over the batches, and the current version of an item is that of its last batch. Within a batch the items must be
distinct. A batch that was written in part is written again under the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.operators.content import term_frequency
from staylens.session import Workspace, staged


@dataclass(frozen=True)
class ContentLedger:
    """The ledger in a folder; ``item_type`` is the type of its items."""

    spark: SparkSession
    path: str
    item_type: T.DataType

    def _read(self, name: str, columns: list[T.StructField], batch: int | None = None) -> DataFrame:
        schema = T.StructType([*columns, T.StructField("batch", T.IntegerType())])
        if batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def items(self, batch: int | None = None) -> DataFrame:
        return self._read("items", [T.StructField("item", self.item_type)], batch)

    def terms(self, batch: int | None = None) -> DataFrame:
        feature, tf = T.StructField("feature", T.StringType()), T.StructField("tf", T.LongType())
        return self._read("terms", [T.StructField("item", self.item_type), feature, tf], batch)

    def frequency(self, batch: int | None = None) -> DataFrame:
        feature, items = T.StructField("feature", T.StringType()), T.StructField("items", T.LongType())
        return self._read("frequency", [feature, items], batch)

    def current(self) -> DataFrame:
        """(item, batch): the last batch of each item."""
        return self.items().groupBy("item").agg(F.max("batch").alias("batch"))

    def append(self, content: DataFrame, batch: int) -> None:
        """Add the items of (item, text) as batch 0, 1, 2 and so on. Their texts are split once."""
        with Workspace(self.spark):
            terms = staged(term_frequency(content), "ledger-terms")
            items = staged(content.select("item"), "ledger-items")
            # What earlier batches held of the items that come again.
            before = self.items(batch).filter(F.col("batch") < batch)
            known = before.join(items, "item", "left_semi").groupBy("item").agg(F.max("batch").alias("batch"))
            gone = self.terms(batch).join(known, ["item", "batch"], "left_semi")
            change = (
                terms.select("feature", F.lit(1).alias("n"))
                .unionByName(gone.select("feature", F.lit(-1).alias("n")))
                .groupBy("feature")
                .agg(F.sum("n").alias("items"))
                .filter(F.col("items") != 0)
            )
            # Items last: they make the batch count.
            for name, table in (("frequency", staged(change, "ledger-change")), ("terms", terms), ("items", items)):
                table.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def idf(self) -> DataFrame:
        """(feature, df, idf) as ``content.idf`` gives it for the current items."""
        count = self.items().agg(F.count_distinct("item")).scalar()
        summed = self.frequency().groupBy("feature").agg(F.sum("items").alias("df")).filter("df > 0")
        return summed.select("feature", "df", F.log((count + 1) / (F.col("df") + 1)).alias("idf"))

    def tfidf(self) -> DataFrame:
        """(item, feature, tf, tfidf) as ``content.tfidf_long`` gives it for the current items."""
        now = self.terms().join(self.current(), ["item", "batch"], "left_semi")
        return now.join(self.idf(), "feature").select(
            "item", "feature", "tf", (F.col("tf") * F.col("idf")).alias("tfidf")
        )
