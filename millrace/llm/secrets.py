"""Secret scans over a ledger of content-addressed blobs, DataFrame functions only.

A blob is the SHA-256 of a text. A store is a folder with two tables: the ledger holds
every blob with the rule versions that it was scanned with, and findings hold what was
found, by blob. A scan looks at each distinct blob once, and only with the rules whose
version it has not met; it appends its findings first and then its part of the ledger, so that
what a lost run left out is scanned again, and findings that stand there twice count
once. Findings are joined back to all paths (rows) that carry the blob: they
are few and broadcast behind a check of their size, else dealt out with salt.

Places are code points. Java's regex gives no positions through Spark, so the
text is split at the matches: gaps and matches alternate, and a running sum of
their lengths gives each match's end. The sum runs over the matches of one text
and rule, never over more. Patterns take time in proportion to a text: what may repeat
gives nothing back, or has a bound.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import saved, scratch

#: Blobs with findings, and bytes of these, that may be broadcast; the salt of a join with more.
SMALL_TABLE, SMALL_BYTES, SALT = 100_000, 16_000_000, 16
LEDGER = "blob binary, versions array<string>"
FINDINGS = "blob binary, rule_version string, kind string, start long, end long"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group `group` has `least` characters.

    hint: a literal that every match holds; texts without it are not searched.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    hint: str | None = None
    base: bool = False

    @property
    def version(self) -> str:
        return f"{self.kind}-{zlib.crc32(f'{self.pattern} {self.least} {self.group}'.encode()):08x}"


#: Base kinds in their order, then further kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]++", 20, hint="AKIA", base=True),
    Rule("hex", r"[0-9a-f]{24,}+", 24, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", 40, hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 15, hint="xox"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 30, hint="eyJ"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----", 20, hint="PRIVATE KEY"),
)


def address(docs: DataFrame) -> DataFrame:
    """The rows' text and its blob; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _matches(rule: Rule, order: int) -> Column:
    """Gap and match lengths of a text under one rule, in turn; the last has no match."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), value.alias("value"))
    found = F.transform(zipped, lambda x, i: F.struct(F.lit(order).alias("rule"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")))
    may = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    return F.when(may & F.array_contains("todo", order), found).otherwise(F.array().cast("array<struct<rule:int,i:int,gap:int,hit:int,value:int>>"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table of a store, None before its first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unseen(docs: DataFrame, store: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Distinct blobs with their text and the numbers of the rules that the ledger lacks for them."""
    blobs = address(docs).groupBy("blob").agg(F.first("text").alias("text"))
    every, versions = F.array(*map(F.lit, range(len(rules)))), F.array(*(F.lit(r.version) for r in rules))
    ledger = _table(docs.sparkSession, f"{store}/ledger", LEDGER)
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.select("blob", F.explode("versions").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
    left = F.filter(every, lambda k: ~F.coalesce(F.array_contains("seen", F.get(versions, k)), F.lit(False)))
    return blobs.join(seen, "blob", "left").withColumn("todo", left).where("size(todo) > 0").select("blob", "text", "todo")


def scan(docs: DataFrame, store: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the store's ledger lacks; append findings, then the pairs scanned."""
    of = lambda what: F.array(*(F.lit(what(r)) for r in rules))
    todo = unseen(docs, store, rules)
    pieces = todo.select("blob", F.explode(F.concat(*(_matches(r, k) for k, r in enumerate(rules)))).alias("m")).select("blob", "m.*")
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(Window.partitionBy("blob", "rule").orderBy("i"))
    placed = pieces.withColumn("end", end).where(F.col("hit").isNotNull() & (F.col("value") >= F.get(of(lambda r: r.least), F.col("rule"))))
    named = placed.select("blob", F.get(of(lambda r: r.version), F.col("rule")).alias("rule_version"), F.get(of(lambda r: r.kind), F.col("rule")).alias("kind"), (F.col("end") - F.col("hit")).alias("start"), "end")
    named.write.mode("append").parquet(f"{store}/findings")
    todo.select("blob", F.transform("todo", lambda k: F.get(of(lambda r: r.version), k)).alias("versions")).write.mode("append").parquet(f"{store}/ledger")


def findings(spark: SparkSession, store: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the store holds of these rule versions, once each: blob, kind, start, end."""
    found = _table(spark, f"{store}/findings", FINDINGS)
    if found is None:
        found = spark.createDataFrame([], FINDINGS)
    return found.where(F.col("rule_version").isin([r.version for r in rules])).select("blob", "kind", "start", "end").distinct()


def joined(rows: DataFrame, by_blob: DataFrame) -> DataFrame:
    """rows (with blob) left joined with one row for each blob that has findings, however many rows a blob has."""
    by_blob = saved(by_blob, "secret-blobs")
    values = [c for c in by_blob.columns if c != "blob"]
    size = by_blob.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*values)))).alias("bytes")).first()
    if size.n <= SMALL_TABLE and (size.bytes or 0) <= SMALL_BYTES:
        return rows.join(F.broadcast(by_blob), "blob", "left")
    salted = by_blob.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).join(salted, ["blob", "__salt"], "left").drop("__salt")


def report(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs with its blob's findings: counts of the base kinds, digest, and all spans."""
    order = {r.kind: k for k, r in enumerate(rules)}
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in order.items()), F.lit(len(order)))
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    base = [r.kind for r in rules if r.base]
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    by_blob = found.groupBy("blob").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base),
        F.array_sort(F.collect_list(span)).alias("found"),
    ).select("blob", *(f"n_{k}" for k in base), listed(F.filter("found", lambda x: x["kind"].isin(base))).alias("base_spans"), listed(F.col("found")).alias("spans"))
    out = joined(address(docs).select("doc_id", "blob"), by_blob)
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(text("base_spans").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"),
    )


def find(docs: DataFrame, store: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the store lacks of all texts, and report on every row from the store.

    Without a store a new, empty one is made in the shared folder, so that all blobs
    are scanned. Null and empty texts have no findings and the digest of the empty string.
    Repeated rows and copies share one blob's findings. Extra columns are ignored.
    """
    store = store or scratch(docs.sparkSession, "secrets")
    scan(docs, store, rules)
    return report(docs, findings(docs.sparkSession, store, rules), rules)


def masked(docs: DataFrame, store: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every finding in text replaced by <kind>; overlapping findings count as one, named by the first.

    Columns and their order stay; texts without findings stay as they are, null texts too.
    """
    store = store or scratch(docs.sparkSession, "secrets")
    scan(docs.select(F.lit(None).alias("doc_id"), "text"), store, rules)
    span = F.struct("start", "end", "kind")
    step = lambda acc, x: F.when(x["start"] < acc["end"], F.struct(F.greatest(acc["end"], x["end"]).alias("end"), acc["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("end"), F.concat(acc["out"], F.array(F.struct(acc["end"].alias("start"), x["start"].alias("stop"), x["kind"].alias("kind")))).alias("out"))
    )
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>").alias("out"))
    cuts = findings(docs.sparkSession, store, rules).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found")).select("blob", F.aggregate("found", zero, step).alias("cuts"))
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    # the other columns go in one, so that no name of theirs can clash
    own = F.struct(F.lit(None).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = joined(docs.select("text", own.alias("own"), blob.alias("blob")), cuts)
    piece = F.transform("cuts.out", lambda x: F.concat(F.substr(F.col("text"), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(piece, ""), F.substr(F.col("text"), (F.col("cuts.end") + 1).cast("int"), F.length("text"))))
    return found.withColumn("text", text).select(*("text" if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns))
