"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated where its target exceeds its
size. A document copy finishes at the source's running total of sizes up to and with it, divided by the
source's target: its virtual finish time. All copies are sorted by finish time across the cluster and
taken while the running total of sizes stays within the budget. So every source has been served the
same share of its target when the budget is used up, to within a document.

Running totals are taken within the partitions of a range sort, and the totals of the partitions before
are added, so a source that holds a third of all rows is spread over many tasks like any other.

Weights per source are the caller's; a source never gets more than ``most`` times its size, and what it
can't take is shared among the others by weight. A null source is a source of its own; a null text has
size 0, is never queued and takes 0. Copies and equal ids are queued one by one. The order depends on
the id alone (ties: on the size), so a rerun takes the same. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import WORD, filled, row_key, shuffle_partitions, starts, unused
from staylens.session import staged

MOST = 3
SEED = 7


def running_totals(
    rows: DataFrame, group: str | None, order: list[str], value: str, name: str = "upto"
) -> DataFrame:
    """``rows`` with the running total of ``value`` in the given order, within each group if named.

    ``order`` should make the order of rows that differ total; equal rows may swap. Values are whole
    numbers of at least 0; the group has no nulls.
    """
    keys = ([group] if group else []) + order
    dealt = rows.repartitionByRange(shuffle_partitions(rows), *keys).sortWithinPartitions(*keys)
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_own", T.LongType())]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(value).to_numpy(zero_copy_only=False)
            sums = np.cumsum(values)
            own = sums + carried
            if group is not None:
                names = batch.column(group).to_numpy(zero_copy_only=False)
                starting = np.append(names[0] != last, names[1:] != names[:-1])
                # What had been summed before the group began.
                before = np.where(starting, sums - values, -carried)
                own = sums - np.maximum.accumulate(before)
                last = names[-1]
            carried = int(own[-1])
            columns = [*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    summed = staged(dealt.mapInArrow(local, schema), "running")
    by = ["_part", group] if group else ["_part"]
    # A row for each partition, and for each group that ends or begins in it.
    ends = summed.groupBy(*by).agg(F.max("_own").alias("_end"))
    if group:
        # Groups with rows in one partition only need no offset.
        wide = ends.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_part", "_end"))).alias("_ends"))
        offsets = wide.filter(F.size("_ends") > 1).select(group, F.inline(_offsets("_ends")))
        joined = summed.join(offsets, ["_part", group], "left")
    else:
        all_ends = ends.agg(F.sort_array(F.collect_list(F.struct("_part", "_end"))).alias("_ends"))
        offsets = all_ends.select(F.inline(_offsets("_ends")))
        joined = summed.join(F.broadcast(offsets), "_part", "left")
    upto = F.col("_own") + F.coalesce("_offset", F.lit(0))
    return joined.select(*rows.columns, upto.alias(name))


def _offsets(ends: str) -> Column:
    """Per partition in a list as long as there are partitions: the sum of those before it."""
    before = starts(F.transform(ends, lambda e: e["_end"]))
    return F.zip_with(
        ends, before, lambda e, s: F.struct(e["_part"].alias("_part"), s.alias("_offset"))
    )


def shared_targets(sources: DataFrame, budget: int, most: int = MOST) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: shares of the budget by weight.

    A target stops at ``most`` times its source's size; the excess is shared anew by weight until no
    target is above. Each round is one sum over the sources. The budget is at most ``most`` times
    the sum of sizes.
    """
    cap, weight = F.col("source_size") * most, F.col("weight")
    level, stopped = 0.0, -1
    while True:
        above = cap <= weight * level
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0)).alias("open"),
            F.count_if(above).alias("stopped"),
        ).first()
        if row.stopped == stopped or not row.open:
            break
        stopped = row.stopped
        level = (budget - row.fixed) / row.open
    if not row.open:
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.least(cap.cast("double"), weight * level))


def code_point_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Weights that repeat along the sources by code point, the null source last.

    ``sources`` has ``source``, distinct.
    """
    ranked = running_totals(
        sources.select("source", F.col("source").isNull().alias("last"), F.lit(1).cast("long").alias("one")),
        None,
        ["last", "source"],
        "one",
        "rank",
    )
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return ranked.select("source", F.get(weights, F.pmod(F.col("rank") - 1, F.lit(len(cycle)))).alias("weight"))


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def mixed(
    docs: DataFrame,
    weights,
    ids: Column | None = None,
    text: str = "text",
    source: str = "source",
    most: int = MOST,
    budget: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Per row: id, source, size, source_size, target (its source's), copies (taken, 0 to ``most``).

    ``weights`` makes a table (source, weight) from the distinct sources. ``budget`` is in words;
    by default all words of all documents.
    """
    ids = F.col("doc_id") if ids is None else ids
    rows = staged(
        docs.select(
            ids.alias("id"),
            F.col(source).cast("string").alias("source"),
            size_of(F.col(text)).alias("size"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "mix-rows",
    )
    rows = rows.withColumn("queue", _key(F.col("source")))
    sizes = rows.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    share = weights(sizes.select("source")).select(_key(F.col("source")).alias("queue"), "weight")
    sources = staged(sizes.drop("source").join(share, "queue"), "mix-sources")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = words if budget is None else min(budget, most * words)
    targets = staged(shared_targets(sources, budget, most), "mix-targets")

    shuffle = F.xxhash64("id", F.lit(seed))
    queued = rows.filter("size > 0").select("queue", shuffle.alias("turn"), "id", "size", "row")
    queued = running_totals(queued, "queue", ["turn", "id", "size", "row"], "size")
    # A copy can only be wanted while the copies before it don't fill the target.
    served = queued.join(targets.filter("target > 0"), "queue")
    last = F.least(F.lit(most - 1), F.floor(F.col("target") / F.col("source_size"))).cast("int")
    copies = served.select(
        "queue", "turn", "row", "size", "upto", "source_size", "target",
        F.explode(F.sequence(F.lit(0), last)).alias("copy"),
    )
    finish = (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target")
    finished = copies.select(finish.alias("finish"), "queue", "turn", "row", "copy", "size")
    order = ["finish", "queue", "turn", "row", "copy"]
    taken = running_totals(finished, None, order, "size", "spent").filter(F.col("spent") <= budget)
    counts = taken.groupBy("row").agg(F.count("*").cast("int").alias("copies"))
    return (
        rows.join(targets, "queue")
        .join(counts, "row", "left")
        .select("id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))
    )


def repeated(docs: DataFrame, weights, text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with their own columns."""
    taken = mixed(docs, weights, row_key(docs), text, source)
    key, wanted, times = (unused(docs, name) for name in ("key", "wanted", "times"))
    # Copies of a row are alike, so one of them stands for what is taken of all.
    counts = (
        taken.groupBy(F.col("id").alias(wanted))
        .agg(F.sum("copies").cast("int").alias(times))
        .filter(F.col(times) > 0)
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, row_key(docs))
    held = keyed.join(counts, F.col(key) == F.col(wanted)).dropDuplicates([key])
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    return held.select(*columns, copies.alias(key)).select(*columns)
