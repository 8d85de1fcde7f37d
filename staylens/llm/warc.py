"""Web archives: writing pages as WARC files, reading them back, and the merged index of captures.

Writing: a page becomes a response record, or a revisit record without payload if another page with the same
payload of at least ``LEAST_BYTES`` holds it; of equal payloads the largest page id is the response, of
equal ids one row. Spark's text writer lays the records down, so archives lie wherever Spark can write.

Reading: each archive is one row of bytes, which a task takes apart record by record. Archives have a bounded
number of records.

Index: the captures of each archive are sorted locally by URL key, timestamp and record: a run. Captures are
dealt to ranges of that order, and in each range the runs meet in a tree of losers that puts them in one
order. Ranges follow each other, so together they are the ordered history of all captures; a URL with a third
of all captures spreads over several ranges by its timestamps.

A null html is the empty payload; a null url is left out of its record and sorts first. Null page ids are the
smallest and stay null. Copies get a record each. Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import filled, shuffle_partitions
from staylens.session import fresh_path

LEAST_BYTES = 1000
RECORDS_PER_FILE = 8192

# Where no capture time is given: seconds from here on, by page id.
FIRST_CAPTURE = 1_704_067_200
SPAN = 1_000_000_000

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _rows(pages: DataFrame, captured_at: Column | None) -> DataFrame:
    """The pages with a number each, written once: later steps must agree on the numbers."""
    payload = filled(F.col("html"))
    seconds = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SPAN))
    when = F.timestamp_seconds(seconds) if captured_at is None else captured_at
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("digest"),
        F.sha2(payload, 256).alias("content"),
        when.alias("captured_at"),
    ).withColumn("record", F.monotonically_increasing_id())
    path = fresh_path(pages.sparkSession, "captures")
    rows.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(rows.schema).parquet(path)


def _revisits(rows: DataFrame, least: int) -> DataFrame:
    """Per record that revisits another: ``record`` and what it refers to."""
    large = rows.filter(F.col("size") >= least).select("content", "page_id", "record")
    held = (
        large.groupBy("content")
        .agg(F.max(F.struct("page_id", "record")).alias("response"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("content", "response")
    )
    return (
        large.join(held, "content")
        .filter(F.col("record") != F.col("response.record"))
        .select(
            "record",
            F.lit(True).alias("revisit"),
            F.col("response.page_id").alias("to_page"),
            F.col("response.record").alias("to_record"),
        )
    )


def _name(page: str, record: str) -> Column:
    number = F.coalesce(F.col(page).cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:page:"), number, F.lit(":"), F.col(record).cast("string"), F.lit(">"))


def _utc(moment: str) -> Column:
    """The moment in UTC, whatever the session's time zone."""
    seconds = F.unix_seconds(moment)
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86_400))
    clock = [F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, rest % 3600 / 60, rest % 60)]
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def _record(revisit: Column) -> Column:
    """A WARC record as text, without the two empty lines after it."""

    def field(name: str, value: Column) -> Column:
        # A field whose value is null is left out.
        return F.concat(F.lit(f"{name}: "), value)

    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(END + END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat_ws(
        END,
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _name("page_id", "record")),
        field("WARC-Date", _utc("captured_at")),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, field("WARC-Refers-To", _name("to_page", "to_record"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(END + END), block)


def write_archives(
    pages: DataFrame, path: str, captured_at: Column | None = None, least: int = LEAST_BYTES
) -> None:
    """Write a folder of gzipped WARC files with a record for every row."""
    rows = _rows(pages, captured_at)
    marked = rows.join(_revisits(rows, least), "record", "left")
    records = marked.select(_record(F.coalesce("revisit", F.lit(False))).alias("value"))
    (
        records.write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


# -- reading


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the path: captures of a site stand together."""
    if url is None:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].partition("#")[0]
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split(END)[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def _page_of(name: str | None) -> int | None:
    page = name.split(":")[2] if name else ""
    return int(page) if page else None


def records_of(archive: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, fields and block of each record of an archive; the length field tells where it ends."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        cut = archive.index(b"\r\n\r\n", at)
        fields = _fields(archive[at:cut])
        start = cut + 4
        end = start + int(fields["content-length"])
        yield at, fields, view[start:end]
        at = end + 4


CAPTURE = {
    "run": pa.string(),
    "offset": pa.int64(),
    "url_key": pa.string(),
    "captured_at": pa.timestamp("us", "UTC"),
    "page_id": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
}
CAPTURE_TYPES = (
    "run string, offset bigint, url_key string, captured_at timestamp, page_id bigint, "
    "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def _capture(run: str, offset: int, fields: dict[str, str], block: memoryview) -> tuple:
    head, _, payload = bytes(block).partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(_fields(head)["content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    return (
        run,
        offset,
        url_key(fields.get("warc-target-uri")),
        datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC),
        _page_of(fields["warc-record-id"]),
        size,
        digest,
        fields["warc-type"],
        _page_of(fields.get("warc-refers-to")),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, k) for c, k in zip(columns, CAPTURE.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(CAPTURE))


def _order(capture: tuple) -> tuple:
    return capture[2], capture[3], capture[0], capture[1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            run = path.as_py().rpartition("/")[2]
            archive = gzip.decompress(content.as_py())
            rows = sorted((_capture(run, *record) for record in records_of(archive)), key=_order)
            if rows:
                yield _batch(rows)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives of a folder; those of an archive are a sorted run.

    Digest and length of a response are taken from the payload that was read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_runs, CAPTURE_TYPES)


# -- index


def merge_runs(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """Merge sorted runs by a tree of losers: each row costs one path of the tree."""
    count = len(runs)
    if not count:
        return
    places = [0] * count
    heads = [key(run[0]) if run else None for run in runs]
    losers = [-1] * count

    def beats(one: int, other: int) -> bool:
        if heads[one] is None or heads[other] is None:
            return heads[other] is None and heads[one] is not None
        return heads[one] < heads[other]

    def play(run: int) -> None:
        node = (run + count) // 2
        while node > 0:
            if losers[node] < 0:
                # While the tree is built the first to come waits for the second.
                losers[node] = run
                return
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        losers[0] = run

    for run in range(count):
        play(run)
    while heads[losers[0]] is not None:
        best = losers[0]
        yield runs[best][places[best]]
        places[best] += 1
        heads[best] = key(runs[best][places[best]]) if places[best] < len(runs[best]) else None
        play(best)


def merged_index(captures: DataFrame) -> DataFrame:
    """The captures in one order by URL key and timestamp, across ranges and within them.

    A range holds its share of the index, a few hundred bytes a capture; with more partitions
    (``spark.sql.shuffle.partitions``) ranges are smaller.
    """
    order = ["url_key", "captured_at", "run", "offset"]
    dealt = captures.repartitionByRange(shuffle_partitions(captures), *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[0], []).append(row)
        out = []
        for row in merge_runs(list(runs.values())):
            out.append(row)
            if len(out) >= RECORDS_PER_FILE:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    runs_in_order = dealt.sortWithinPartitions("run", *order)
    return runs_in_order.select(*CAPTURE).mapInArrow(merge, CAPTURE_TYPES)
