"""Command line programs: ``python -m plenaria.cli ingest | extract | analyze``."""

from __future__ import annotations

import argparse
import functools
import logging
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, extraction, graph, vectors
from .operators.results import extract_once
from .plans import catalogue
from .settings import named, settings
from .sources.tei import TranscriptSource, documents, parse
from .storage import drop, work_dir
from .streaming.incremental import drain

log = logging.getLogger("plenaria")


def session() -> SparkSession:
    return SparkSession.builder.appName("plenaria").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Transcripts into the graph; with dry_run, only their count. Files that fail are counted. With incremental, only
    files that no such run has taken: Spark keeps their list beside the graph. Files are parsed once, and counted as
    they pass; what is written again after a run that was cut off changes nothing."""
    began = time.time()
    source = TranscriptSource(args.country, args.min_tokens, [s.upper() for s in args.subcorpus or []])
    report = {"documents": 0, "errors": 0}

    def take(files, number: int = 0) -> None:
        spark = files.sparkSession
        counts, errors = Observation(), Observation()
        parsed = parse(files).observe(errors, F.count("error").alias("errors"))
        rows = documents(parsed, source.country, source.min_tokens, source.subcorpora, trace=True)
        rows = rows.observe(counts, F.count(F.lit(1)).alias("documents"))
        if args.dry_run:
            rows.write.format("noop").mode("overwrite").save()
        else:
            path = work_dir(spark, "documents")
            try:
                rows.write.parquet(path)
                graph.GraphStore(spark, args.graph_dir, settings().text_cap or None).upsert_documents(spark.read.schema(rows.schema).parquet(path))
            finally:
                drop(spark, path)
        for found in (counts.get, errors.get):
            for name, n in found.items():
                report[name] += n or 0

    if args.incremental and not args.dry_run:
        stream = source.files(spark, args.data_dir, stream=True).writeStream.foreachBatch(take)
        stream = stream.option("checkpointLocation", f"{args.graph_dir}/ingested").trigger(availableNow=True)
        stream.start().awaitTermination()
    else:
        take(source.files(spark, args.data_dir))
    report["rate"] = round(report["documents"] / max(time.time() - began, 1e-9), 1)
    return report


def extract(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Extract from speeches not yet processed, batch by batch, until none is left. What has been
    processed is kept apart from the results, so a speech without a sentiment is not taken again; results are kept by
    text, so no text is asked about twice. Speeches to be done are looked up once and written to files of a batch
    each, which are drained. A batch that fails is counted and left for the next run; an interrupt ends the run with
    its report."""
    s, store = settings(), graph.GraphStore(spark, args.graph_dir)
    done, asked = f"{args.graph_dir}/processed", f"{args.graph_dir}/results"
    spark.createDataFrame([], "speech_id string").write.mode("append").parquet(done)  # the folder, if it is new
    processed = spark.read.schema("speech_id string").parquet(done)
    todo = store.unprocessed(processed, args.country.upper()).select(F.col("speech_id").alias("doc_id"), F.col("raw_text").alias("text"))
    path = work_dir(spark, "extract")
    todo.write.option("maxRecordsPerFile", args.batch_size).parquet(f"{path}/todo")

    def process(batch, number: int) -> None:
        session = batch.sparkSession
        texts = batch.filter(F.length(F.trim("text")) > 0)
        results = extract_once(
            texts, asked, named(s.entity_backend), named(s.reply_backend), s.results_version,
            llm=not args.no_llm, threshold=s.entity_threshold, least_words=s.least_words,
        )
        graph.GraphStore(session, args.graph_dir).upsert_extractions(results)
        batch.select(F.col("doc_id").alias("speech_id")).write.mode("append").parquet(done)

    try:
        report = drain(
            spark, f"{path}/todo", todo.schema, process, f"{path}/checkpoint", args.max_batches, files_per_batch=1
        )
    finally:
        drop(spark, path)
    return {"documents": report.rows, "batches": report.batches, "errors": len(report.errors), "rate": round(report.rate, 1)}


def _csv(df, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # reports: a row per party and year


def analyze(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Embeddings of speeches without one, evaluation, and longitudinal reports as CSV."""
    store, country = graph.GraphStore(spark, args.graph_dir), args.country.upper()
    report: dict = {}
    if args.step in ("all", "embeddings"):
        own = store.read("speeches").filter((F.col("country_code") == country) & F.col("year").between(args.start_year, args.end_year))
        missing = own.join(store.read("embeddings").select(F.col("doc_id").alias("speech_id")), "speech_id", "left_anti")
        s = settings()
        embedder = named(s.embedder) or functools.partial(extraction.HashingEmbedder, s.embedding_dim)
        model = s.embedding_model or getattr(embedder, "model_name", extraction.HashingEmbedder.model_name)
        records = extraction.embed(missing.withColumnsRenamed({"speech_id": "doc_id", "raw_text": "text"}), embedder, model_name=model)
        store.upsert_embeddings(records)
    embedded = store.vectors(country)
    if args.step in ("all", "evaluate"):
        if args.compare_models:
            names = [r[0] for r in embedded.select("model_name").distinct().collect()]
            candidates = {n: embedded.filter(F.col("model_name") == n) for n in sorted(names)}
            report["best"], report["results"] = evaluation.tournament(candidates)
        else:
            found = evaluation.evaluate(embedded, "stored", plot="graph" if args.plot else False)
            if args.plot:
                evaluation.write_plot(found.pop("points"), f"{args.output_dir}/vectors_{country}", f"Speeches of {country}")
            report["evaluation"] = found
    if args.step in ("all", "longitudinal"):
        speeches = store.read("speeches")
        trend = catalogue.complexity_trend(speeches, country, args.start_year, args.end_year)
        _csv(trend, f"{args.output_dir}/complexity_trends_{country}")
        _csv(catalogue.sentiment_trend(speeches, country, args.start_year, args.end_year, None), f"{args.output_dir}/sentiment_trends_{country}")
        means = vectors.centroids(embedded).persist()
        if args.party_a and args.party_b:
            _csv(vectors.drift(means, args.party_a, args.party_b, args.start_year, args.end_year), f"{args.output_dir}/drift_{country}")
            for party in (args.party_a, args.party_b):
                _csv(vectors.velocity(means, party, args.start_year, args.end_year), f"{args.output_dir}/velocity_{country}_{party.replace(' ', '_')}")
        _csv(vectors.distance_matrix(means, args.end_year), f"{args.output_dir}/distances_{country}_{args.end_year}")
        means.unpersist()
        report["latest"] = [r.asDict() for r in catalogue.latest_per_party(trend, ["avg_ttr", "avg_fk_grade"]).collect()]
    return report


def parser() -> argparse.ArgumentParser:
    s = settings()
    top = argparse.ArgumentParser(prog="plenaria")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--country", "-c", required=True)
        p.add_argument("--graph-dir", default=s.graph_dir)
        p.add_argument("--log-level", default=s.log_level)
        return p

    p = command("ingest", ingest)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--batch-size", type=int, default=s.batch_size, help="kept for compatibility; Spark sizes its own tasks")
    p.add_argument("--min-tokens", type=int, default=s.min_tokens)
    p.add_argument("--subcorpus", nargs="*")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--incremental", action="store_true", help="take only files that no incremental run has taken")
    p = command("extract", extract)
    p.add_argument("--batch-size", type=int, default=100_000, help="most speeches a batch: each is a Spark job over all executors")
    p.add_argument("--max-batches", type=int, default=-1)
    p.add_argument("--no-llm", action="store_true")
    p = command("analyze", analyze)
    p.add_argument("--start-year", type=int, default=2010)
    p.add_argument("--end-year", type=int, default=2024)
    p.add_argument("--step", choices=("all", "embeddings", "evaluate", "longitudinal"), default="all")
    p.add_argument("--party-a")
    p.add_argument("--party-b")
    p.add_argument("--compare-models", action="store_true")
    p.add_argument("--plot", action="store_true", help="lay the vectors out in two dimensions and write a page with them")
    p.add_argument("--output-dir", default=s.output_dir)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    print(args.run(session(), args))


if __name__ == "__main__":
    main()
