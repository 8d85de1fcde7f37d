"""Secret scans over every version of a text, by an incremental ledger of blobs.

A version is a row with a path and a text. Its blob is the digest of the text, so equal texts, however
many paths hold them, are one blob. The ledger is a table of (blob, rule, findings): one row for each
blob and rule version that was ever scanned, with or without findings. A scan takes the distinct blobs
of the versions given, leaves out each pair of blob and rule that the ledger has, scans the rest, and
the caller appends the new rows. Findings are then joined back to all paths by blob. A changed pattern
gets a new version and so is scanned anew, the others are not.

All expressions are Spark's own. A null text is the empty text, which has no findings. Copies share
their findings; equal paths each keep their row; only the path, the text and columns the caller names
are read, so others may have any name. Positions count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import filled, let, starts, unused
from staylens.session import fresh_path

KINDS = ("assign", "access", "hex")

FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts if its group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


# The patterns. Of runs (access, hex) a shorter one can hold no longer one, so the least
# length stands in the pattern; a short assignment uses up its characters and is dropped afterwards.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

PLACEHOLDER = "[REDACTED]"

# Code points of a text that are searched for findings to replace at once.
BLOCK = 4096


def blob_of(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(filled(text), 256)


def found(text: Column, rule: Rule) -> Column:
    """The findings of one rule in a text: leftmost matches that do not overlap.

    Spark returns matches without their places; the gaps between them are what the same pattern
    splits the text into, so a match starts after all earlier gaps and matches.
    """

    def placed(matches: Column, groups: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        sizes = F.transform(matches, F.length)
        steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, m: g + m)

        def spans(ends_before: Column, g: Column) -> Column:
            all_spans = F.transform(
                matches,
                lambda m, i: F.struct(
                    F.lit(rule.kind).alias("kind"),
                    (F.get(ends_before, i) + F.get(g, i)).cast("long").alias("start"),
                    (F.get(ends_before, i) + F.get(g, i) + F.length(m)).cast("long").alias("end"),
                    F.length(F.get(groups, i)).alias("size"),
                ),
            )
            return F.transform(
                F.filter(all_spans, lambda s: s["size"] >= rule.least),
                lambda s: F.struct(s["kind"], s["start"], s["end"]),
            )

        return let(starts(steps), lambda e: let(gaps, lambda g: spans(e, g)))

    none = F.array().cast(FINDINGS)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # A text is searched once; the few that match are taken apart.
    return F.when(~text.rlike(rule.pattern), none).otherwise(
        let(matches, lambda m: let(groups, lambda g: placed(m, g)))
    )


def redacted(text: Column, findings: Column) -> Column:
    """The text with each stretch that findings cover replaced, findings that overlap as one.

    ``findings`` are sorted by start. The text is cut into blocks first, so that its places are found in steps in
    proportion to its length; a stretch over several blocks leaves its placeholder in the first.
    """

    def block_without(block: Column, low: Column, found: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))

        def step(state: Column, f: Column) -> Column:
            begin, end = f["start"] - low, f["end"] - low
            gap = F.substring(block, (state["upto"] + 1).cast("int"), (begin - state["upto"]).cast("int"))
            # What begins in an earlier block or within the last stretch goes on with that one.
            goes_on = (begin < 0) | (begin < state["upto"])
            out = F.when(goes_on, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(PLACEHOLDER)))
            return F.struct(out.alias("out"), F.greatest(end, state["upto"]).alias("upto"))

        rest = lambda s: F.concat(s["out"], F.substring(block, (s["upto"] + 1).cast("int"), F.lit(BLOCK)))
        return F.aggregate(found, start, step, rest)

    def here(block: Column, i: Column) -> Column:
        low = (i * BLOCK).cast("long")
        found = F.filter(findings, lambda f: (f["end"] > low) & (f["start"] < low + BLOCK))
        return let(found, lambda some: F.when(F.size(some) == 0, block).otherwise(block_without(block, low, some)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.array_join(F.transform(blocks, here), "")


def blobs_of(versions: DataFrame, text: str = "text") -> DataFrame:
    """The distinct blobs of the versions with their content; copies meet in the map tasks first."""
    content = filled(F.col(text))
    return versions.select(blob_of(F.col(text)).alias("blob"), content.alias("content")).dropDuplicates(
        ["blob"]
    )


def scan_unseen(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
) -> DataFrame:
    """The new ledger rows: blob, rule, findings, for each pair that the ledger lacks."""
    blobs = blobs_of(versions, text)
    if ledger is None:
        seen = F.array().cast("array<string>")
        unseen = blobs.withColumn("seen", seen)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        none = F.array().cast("array<string>")
        unseen = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", none))
    pairs = [
        F.when(
            ~F.array_contains("seen", rule.name),
            F.struct(
                F.lit(rule.name).alias("rule"), found(F.col("content"), rule).alias("findings")
            ),
        )
        for rule in rules
    ]
    return unseen.select("blob", F.inline(F.array_compact(F.array(*pairs))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"blob string, rule string, findings {FINDINGS}").parquet(path)


def update_ledger(
    versions: DataFrame,
    path: str,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
) -> DataFrame:
    """Append what is unseen to the ledger at ``path`` and return the whole ledger.

    ``ledger`` is what the path held before; None starts a new one.
    """
    scan_unseen(versions, ledger, rules, text).write.mode("append").parquet(path)
    return read_ledger(versions.sparkSession, path)


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger in the shared folder."""
    return fresh_path(spark, "ledger")


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with findings under the rules named: all of them by start, then kind.

    A ledger to which two updates added the same pair of blob and rule gives its findings once.
    """
    order = {rule.kind: n for n, rule in enumerate(rules)}

    def keyed(finding: Column) -> Column:
        rank = F.lit(len(order))
        for kind, n in order.items():
            rank = F.when(finding["kind"] == kind, F.lit(n)).otherwise(rank)
        return F.struct(
            finding["start"].alias("start"),
            rank.alias("rank"),
            finding["end"].alias("end"),
            finding["kind"].alias("kind"),
        )

    return (
        ledger.filter(F.col("rule").isin([r.name for r in rules]) & (F.size("findings") > 0))
        .groupBy("blob")
        .agg(F.flatten(F.collect_set("findings")).alias("findings"))
        .select("blob", F.sort_array(F.transform("findings", keyed)).alias("findings"))
    )


def findings_by_path(
    versions: DataFrame,
    ledger: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Per version: its path, its blob and its findings (empty where there is none)."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    paths = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"))
    return paths.join(findings_by_blob(ledger, rules), "blob", "left").select(
        F.col("path").alias(path), "blob", F.coalesce("findings", none).alias("findings")
    )


def count_of(findings: str, kind: str) -> Column:
    """How many of the findings are of one kind."""
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")


def spans_text(findings: Column) -> Column:
    """``kind:start:end`` of all findings, comma-joined."""
    one = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.array_join(F.transform(findings, one), ",")


def redact(
    docs: DataFrame,
    ledger: DataFrame,
    text: str = "text",
    size: str = "n_chars",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """The rows with what the ledger found replaced; ``size``, if there, becomes the new length."""
    mark, spans = unused(docs, "dirty"), unused(docs, "spans")
    dirty = findings_by_blob(ledger, rules).select(F.col("blob").alias(mark), F.col("findings").alias(spans))
    joined = docs.join(dirty, blob_of(F.col(text)) == F.col(mark), "left")
    clean = F.when(F.col(mark).isNull(), F.col(text)).otherwise(redacted(filled(F.col(text)), F.col(spans)))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    result = joined.select(*columns)
    if size not in docs.columns:
        return result
    length = F.length(text).cast(docs.schema[size].dataType)
    return result.withColumn(size, F.when(F.col(text).isNull(), F.col(size)).otherwise(length))
