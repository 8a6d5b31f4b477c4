"""Secret scans over an incremental blob ledger.

Every historical version of a file is addressed by the SHA-256 of its content, so a content that occurs at many paths
or in many commits is one blob. The ledger (two Parquet tables in one folder) records which (blob, rule version) pairs
have been scanned and what they yielded. A scan reads only pairs that the ledger lacks, appends to the ledger, and
joins the ledger's findings back to every path. Changing a rule means a new version, which is scanned again while all
other rules' findings stay.

Only DataFrame functions are used. Positions come from splitting a text at a rule's matches: the pieces between matches
and the matches alternate, so a match's start is the sum of the lengths before it. That sum is a window over the few
rows of matches, never over text, and needs no exchange of its own for blobs are dealt by their hash already.

Scale: texts move once (by hash, after equal blobs of a task have been merged); rows of paths carry hash and path only.
A blob at a third of all paths makes one hot key in the last join, whose rows adaptive execution splits.

Crash safety: a run writes its findings first and its scanned pairs last, both under its run id; findings whose pairs
were never written are ignored, and the next run scans those pairs again.

Defined results: null content is empty content; spans are code points, end exclusive; repeated rows keep their number;
rows with null paths or ids come back like others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewatch.llm.common import fresh, scratch_dir, store

#: Buckets of blob ids by which texts without findings are told; at most so many numbers are broadcast (about 25 MB).
BUCKETS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """pattern matches without empty matches; its matches are dropped unless keep matches the whole of one.

    hint is a cheap pattern without which there is no match; equal texts of both patterns share a version.
    """

    name: str
    pattern: str
    version: int = 1
    keep: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base kinds in their listed order. For access and hex a bounded repeat gives the matches that are long enough.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        keep=r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$""",
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

_SCANS = "blob string, rule string, run string"
_FINDINGS = "blob string, rule string, start bigint, end bigint, run string"


class Ledger:
    """The scanned pairs and findings below one folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.scans_path, self.findings_path = spark, f"{folder}/scans", f"{folder}/findings"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scans(self) -> DataFrame:
        return self._read(self.scans_path, _SCANS)

    def findings(self) -> DataFrame:
        """The findings of finished runs."""
        return self._read(self.findings_path, _FINDINGS).join(self.scans(), ["blob", "rule", "run"], "left_semi")

    def is_new(self) -> bool:
        return self.scans().isEmpty()

    def append(self, findings: DataFrame, scans: DataFrame) -> None:
        findings.write.mode("append").parquet(self.findings_path)
        scans.write.mode("append").parquet(self.scans_path)


def blob_id(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")).cast("binary"), 256)


def _pieces(content: Column, rule: Rule) -> Column:
    """For each match of a rule: its number, the length before it since the last match, its length and whether it stays."""
    matches = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(content, rule.pattern, -1)
    stays = (lambda m: m.rlike(rule.keep)) if rule.keep else (lambda m: F.lit(True))
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(0))).alias("g")),
        lambda z, k: F.struct(
            k.alias("number"),
            F.char_length(z["g"]).alias("gap"),
            F.char_length(z["m"]).alias("size"),
            stays(z["m"]).alias("stays"),
        ),
    )
    none = F.array().cast("array<struct<number:int,gap:int,size:int,stays:boolean>>")
    return F.when(content.rlike(rule.pattern), rows).otherwise(none)


def scan_blobs(pending: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (blob, rule, start, end) of blobs: columns blob, content and todo, the keys of the rules to apply."""
    per_rule = [
        F.struct(
            F.lit(rule.key).alias("rule"),
            F.when(F.array_contains("todo", rule.key), _pieces(F.col("content"), rule)).alias("pieces"),
        )
        for rule in rules
    ]
    pieces = (
        pending.select("blob", F.inline(F.array(*per_rule)))
        .where(F.size("pieces") > 0)
        .select("blob", "rule", F.inline("pieces"))
    )
    before = F.sum(F.expr("cast(gap as bigint) + size")).over(
        # ordered within one rule of one blob: at most as many rows as a text has matches
        _window("blob", "rule")
    )
    return pieces.select(
        "blob", "rule", "stays", (before - F.col("size")).alias("start"), before.alias("end")
    ).where("stays").drop("stays")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)


def update(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the pairs of blobs and rule versions that the ledger lacks. versions: column content."""
    keys = [rule.key for rule in rules]
    run = uuid.uuid4().hex
    blobs = (
        versions.select(blob_id(F.col("content")).alias("blob"), F.coalesce("content", F.lit("")).alias("content"))
        .groupBy("blob").agg(F.first("content").alias("content"))
    )
    every = F.array(*map(F.lit, keys))
    if ledger.is_new():
        pending = blobs.withColumn("todo", every)
    else:
        seen = ledger.scans().where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        pending = (
            blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0).drop("seen")
        )
    stamp = F.lit(run).alias("run")
    findings = scan_blobs(pending, rules).select("blob", "rule", "start", "end", stamp)
    # The pairs are found again from the versions: the ledger is unchanged until they are appended.
    names = versions.select(blob_id(F.col("content")).alias("blob")).distinct()
    if ledger.is_new():
        done = names.select("blob", F.explode(every).alias("rule"), stamp)
    else:
        pairs = names.select("blob", F.explode(every).alias("rule"))
        done = pairs.join(ledger.scans(), ["blob", "rule"], "left_anti").select("blob", "rule", stamp)
    ledger.append(findings, done)


def spans_of_blobs(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with findings: spans, an array of start, place (the rule's number in rules), end and kind, in order."""
    place = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.key, k)])
    kind = F.create_map(*[F.lit(x) for rule in rules for x in (rule.key, rule.name)])
    own = ledger.findings().where(F.col("rule").isin([rule.key for rule in rules]))
    span = F.struct("start", place[F.col("rule")].alias("place"), "end", kind[F.col("rule")].alias("kind"))
    return own.distinct().groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def scan_history(
    versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, content: str = "content"
) -> DataFrame:
    """versions, without their content, with blob and spans added (in place of columns of these names).

    Brings the ledger up to date first.
    """
    update(versions.select(F.col(content).alias("content")), ledger, rules)
    stay = [c for c in versions.columns if c not in (content, "blob", "spans")]
    paths = versions.select(*[F.col(f"`{c}`") for c in stay], blob_id(F.col(content)).alias("blob"))
    of_blob = fresh(versions, "of_blob")
    spans = spans_of_blobs(ledger, rules).withColumnRenamed("blob", of_blob)
    none = F.array().cast(spans.schema["spans"].dataType)
    return (
        paths.join(spans, F.col("blob") == F.col(of_blob), "left").drop(of_blob)
        .withColumn("spans", F.coalesce("spans", none))
    )


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digests(documents: DataFrame, ledger_folder: str | None = None) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans as text."""
    spark = documents.sparkSession
    ledger = Ledger(spark, ledger_folder or scratch_dir(spark, "secret-ledger"))
    found = scan_history(documents.select("doc_id", F.col("text").alias("content")), ledger)
    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))
    counts = [F.array_size(F.filter("spans", _is(r.name))).cast("long").alias(f"n_{r.name}") for r in BASE_RULES]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), "blob",
    )


def redacted(text: Column, spans: Column) -> Column:
    """A text with its spans replaced by their kinds in brackets; overlapping spans make one replacement."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], between, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)


def _bucket(blob: Column) -> Column:
    return F.pmod(F.xxhash64(blob), F.lit(BUCKETS))


def without_secrets(documents: DataFrame, ledger_folder: str | None = None) -> DataFrame:
    """documents with every span of their texts replaced; n_chars follows the text.

    Texts whose bucket has no blob with findings stay where they are; only the others may be dealt by their hash.
    """
    spark = documents.sparkSession
    ledger = Ledger(spark, ledger_folder or scratch_dir(spark, "secret-ledger"))
    update(documents.select(F.col("text").alias("content")), ledger)
    blob, found, new, bucket = (fresh(documents, stem) for stem in ("of_blob", "found_spans", "new_text", "of_bucket"))
    spans = store(spans_of_blobs(ledger).select(F.col("blob").alias(blob), F.col("spans").alias(found)), "secret-spans")
    own = blob_id(documents["text"])
    buckets = F.broadcast(spans.select(_bucket(F.col(blob)).alias(bucket)).distinct())
    some, others = (documents.join(buckets, _bucket(own) == F.col(bucket), how) for how in ("left_semi", "left_anti"))
    met = some.join(spans, own == F.col(blob), "left")
    none = F.array().cast(spans.schema[found].dataType)
    out = met.withColumn(new, redacted(F.col("text"), F.coalesce(found, none)))
    kept = {"text": F.col(new).alias("text")}
    if "n_chars" in documents.columns:
        count = F.when(F.size(found) > 0, F.char_length(new).cast("bigint")).otherwise(F.col("n_chars"))
        kept["n_chars"] = count.cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[kept.get(c, F.col(f"`{c}`")) for c in documents.columns]).union(others)
