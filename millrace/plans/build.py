"""Whole runs: build a dataset from its sources, or clean a stored one again.

    python -m millrace.plans.build build OUT [--pages PARQUET [--robots PARQUET]] [--sites a,b] [--max-pages N]
        [--tmx FILE or DIR | --bench DIR --split dev] [--tico-max N] [--sentences FILE --links FILE | --pairs DIR]
        [--labelled PARQUET] [--single-file] [--no-report] [--challenges FILE] [--next-steps FILE]
    python -m millrace.plans.build reclean OUT

OUT is a dataset of versions, see sources.datasets. --labelled has texts of known language (text, lang).
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import langid, rules
from millrace.functions.session import held, saved
from millrace.operators.cleaning import clean
from millrace.operators.records import SCHEMA, assign_ids, number, validate
from millrace.plans import profile
from millrace.sources import datasets, html, pairs

#: Sources in the order in which their rows come.
SOURCES = ("scraped", "tico19", "tatoeba")


def merge(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union of the sources' records with the order (_src, _seq); without any, an empty table of records."""
    out = spark.createDataFrame([], f"_src int, _seq string, {SCHEMA}")
    for k, name in enumerate(SOURCES):
        if name in frames:
            df = frames[name]
            order = [c for c in ("_site", *html.PLACE, "seq") if c in df.columns]
            key = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 20, "0") if c != "seq" else F.to_json(F.struct("seq")) for c in order))
            if order == ["seq"]:
                kind = dict(df.dtypes)["seq"]
                if kind.startswith("struct"):
                    names = [f.name for f in df.schema["seq"].dataType]
                    key = F.concat_ws("/", *(F.lpad(F.col(f"seq.{n}").cast("string"), 20, "0") if n != "file" else F.col("seq.file") for n in names))
                else:
                    key = F.lpad(F.col("seq").cast("string"), 20, "0")
            out = out.unionByName(df.select(F.lit(k).alias("_src"), key.alias("_seq"), *rules.COLUMNS))
    return out


def finish(df: DataFrame, order: list[str], detect: Callable[[Column], Column] = langid.detect, drop: Callable[[], None] = lambda: None) -> tuple[DataFrame, dict[str, int]]:
    """Clean, number and validate; ValueError with the problems if there are any. The rows stand in a scratch table. drop: deletes the input's."""
    cleaned, counts = clean(df, order, detect, stats=True)
    cleaned, drop_cleaned = held(cleaned, "cleaned")
    drop()
    out = assign_ids(cleaned, order)
    drop_cleaned()
    if problems := validate(out):
        raise ValueError(f"schema validation failed: {problems}")
    return out, counts()


def build(spark: SparkSession, frames: dict[str, DataFrame], detect: Callable[[Column], Column] = langid.detect) -> tuple[DataFrame, dict]:
    """Dataset and statistics from the sources' records."""
    merged, drop = held(merge(spark, frames), "merged")
    n = {r["_src"]: r["count"] for r in merged.groupBy("_src").count().collect()}
    out, stats = finish(merged, ["_src", "_seq"], detect, drop)
    return out, {"built_at": datetime.now(UTC).isoformat(), "source_counts": {name: n.get(k, 0) for k, name in enumerate(SOURCES) if name in frames}, "cleaning": stats, "output_rows": stats["output"]}


def reclean(df: DataFrame, detect: Callable[[Column], Column] = langid.detect) -> tuple[DataFrame, dict]:
    """A stored dataset under the present rules, in its own order, with new ids."""
    rows = df.withColumnRenamed("PSA_ID", "_id") if "PSA_ID" in df.columns else df.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_n", profile.place(F.col("_id"))).withColumn("PSA_ID", F.lit(""))
    out, stats = finish(rows, ["_n", "_id"], detect)
    sources = out.groupBy(F.col("Source").alias("key")).agg(F.count("*").alias("rows"), F.min("PSA_ID").alias("first"))
    per = {r["key"]: r["rows"] for r in sources.orderBy(F.desc("rows"), profile.place(F.col("first"))).collect()}
    return out, {"built_at": datetime.now(UTC).isoformat(timespec="seconds"), "mode": "reclean (no rescrape)", "cleaning": stats, "rows_total": stats["output"], "rows_per_source": per}


def store(df: DataFrame, stats: dict, path: str, report: dict | None = None, single: bool = False, made: bool = False) -> str:
    """A new version of a dataset: rows, statistics, profile and, with what it says, the report; published when all is written.
    made: the rows stand in a table already, as those of build and reclean do, and are not kept once more."""
    df, drop = (df, lambda: None) if made else held(df, "dataset")
    draft = datasets.Draft(df.sparkSession, path)
    draft.rows(df, single=single)
    draft.text("stats.json", json.dumps(stats, indent=2, ensure_ascii=False))
    draft.table("profile", profile.state(df, profile.place(F.col("PSA_ID"))).coalesce(1))
    if report is not None:
        draft.text("report.md", profile.report(df, "Corpus report", path, state_of=df.sparkSession.read.parquet(f"{draft.folder}/profile"), **report))
    drop()
    return draft.publish()


def append(df: DataFrame, path: str, report: dict | None = None) -> str:
    """A new version with records behind those of the last: they get the next ids, and their profile is added to the last one's.

    The last version's rows are copied as they are; only the new ones are numbered and profiled."""
    spark = df.sparkSession
    old, known = datasets.read(spark, path), datasets.table(spark, path, "profile")
    n = known.where("kind = 'en'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = F.col("_n") if "_n" in df.columns else F.monotonically_increasing_id()
    new = saved(number(df.withColumn("_n", order), ["_n"], "_at"), "appended")
    records = new.withColumn("PSA_ID", F.format_string("PSA%06d", F.col("_at") + n)).select(*rules.COLUMNS)
    if problems := validate(records):
        raise ValueError(f"schema validation failed: {problems}")
    draft = datasets.Draft(spark, path)
    both = old.select(*rules.COLUMNS).unionByName(records)
    draft.rows(both)
    draft.table("profile", profile.merged(known, profile.shifted(profile.state(new, F.col("_at")), n)).coalesce(1))
    draft.text("stats.json", json.dumps({"built_at": datetime.now(UTC).isoformat(), "mode": "append", "rows_before": n, "rows_added": new.count()}, indent=2))
    if report is not None:
        draft.text("report.md", profile.report(both, "Corpus report", path, state_of=spark.read.parquet(f"{draft.folder}/profile"), **report))
    return draft.publish()


def sources(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Records of the sources that the arguments name."""
    frames = {}
    if a.pages:
        policies = spark.read.parquet(a.robots) if a.robots else None
        frames["scraped"] = html.collect_all(spark.read.parquet(a.pages), a.sites.split(",") if a.sites else None, a.max_pages, policies=policies)
    if a.split != "tmx_all" and a.bench:
        frames["tico19"] = pairs.import_memory(pairs.bench(spark, a.bench, a.split), a.split, a.tico_max)
    elif a.tmx:
        frames["tico19"] = pairs.import_memory(pairs.tmx(spark, a.tmx if a.tmx.endswith(".tmx") else pairs.tmx_path(spark, a.tmx)), max_pairs=a.tico_max)
    if a.sentences and a.links:
        frames["tatoeba"] = pairs.import_sentences(pairs.read_exports(spark, a.sentences, a.links))
    elif a.pairs:
        frames["tatoeba"] = pairs.import_sentences(pairs.read_pairs(spark, a.pairs))
    return frames


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("mode", choices=("build", "reclean"))
    p.add_argument("out")
    for name in ("pages", "robots", "sites", "tmx", "bench", "sentences", "links", "pairs", "labelled", "challenges", "next-steps"):
        p.add_argument(f"--{name}")
    p.add_argument("--split", choices=("tmx_all", "dev", "test"), default="tmx_all")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--tico-max", type=int)
    p.add_argument("--single-file", action="store_true")
    p.add_argument("--report", action=argparse.BooleanOptionalAction, default=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    detect = langid.learned(spark, spark.read.parquet(a.labelled)) if a.labelled else langid.detect
    told = lambda file: [r.value for r in spark.read.text(file).collect() if r.value.strip()] if file else []  # noqa: E731  a report's own lines
    try:
        df, stats = build(spark, sources(spark, a), detect) if a.mode == "build" else reclean(datasets.read(spark, a.out), detect)
    except ValueError as problem:
        print(problem, file=sys.stderr)
        return 1
    store(df, stats, a.out, {"challenges": told(a.challenges), "next_steps": told(a.next_steps)} if a.report else None, a.single_file, made=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
