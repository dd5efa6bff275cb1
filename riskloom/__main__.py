"""Jobs for spark-submit or ``python -m riskloom <job>``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.keyword_index import INDEX, KEPT, keyword_blocks
from riskloom.operators.sizing import spread
from riskloom.plans import copilot, warehouse
from riskloom.plans.layers import bronze_to_silver, build_layers, silver_to_gold
from riskloom.schemas import CONTRACTS, PRIMARY_KEYS, Contract
from riskloom.session import staged, tune
from riskloom.sources import files, key_index, sinks
from riskloom.sources.snapshots import read_snapshot, replace_table
from riskloom.streaming import suspicious


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Eval cases from JSON lines, or from a YAML file where a YAML parser is installed."""
    schema = "id string, question string, expected_terms array<string>, requires_sql boolean"
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML cases needs the yaml package; use JSON lines instead") from error
        text = spark.read.text(path, wholetext=True).first()["value"]
        cases = [
            (str(c["id"]), str(c["question"]), [str(t) for t in c.get("expected_terms", [])],
             bool(c.get("requires_sql", False)))
            for c in (yaml.safe_load(text) or {}).get("cases", [])
        ]
        return spark.createDataFrame(cases, schema)
    return files.scan_jsonl(spark, path, schema)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riskloom")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *required: str, **optional: object) -> None:
        sub = jobs.add_parser(name)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            sub.add_argument(f"--{option.replace('_', '-')}", default=default)

    job("validate", "input", "contract", multi_line=None)
    job("bronze", "raw", "lake", batch_id=None)
    job("layers", "raw", "lake", batch_id=None, multi_line=None)
    job("silver", "lake")
    job("gold", "lake")
    job("load", "raw", audit=None, multi_line=None)
    job("marts")
    job("test")
    job("publish", "input", "output", "checkpoint")
    job("consume", "input", "output", "checkpoint", interval=None, unique=None, dead_letters=None)
    job("unique", "input", "contract", "index", "batch-id", multi_line=None)
    job("index", "corpus", "index")
    job("ask", "questions", "audit", corpus=None, index=None)
    job("evals", "cases", corpus=None, index=None)
    return top


def read_contract(spark: SparkSession, name: str) -> Contract:
    """A known contract, or one from a file."""
    return CONTRACTS.get(name) or Contract.from_json(spark.read.text(name, wholetext=True).first()["value"])


def read_corpus(spark: SparkSession, paths: str) -> DataFrame:
    """The documents under some paths, parted by commas."""
    return spread(files.scan_corpus(spark, paths.split(",")), "source")


def answers_of(spark: SparkSession, questions: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Answers from the documents that are named, or from a kept index of them."""
    if not (args.corpus or args.index):
        raise ValueError("name a corpus or an index")
    index = read_snapshot(spark, args.index, INDEX) if args.index else None
    return copilot.answer_batch(questions, None if args.index else read_corpus(spark, args.corpus), index=index)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run one job; returns the exit code."""
    if args.job == "validate":
        contract = read_contract(spark, args.contract)
        passed, lines = warehouse.validate_csv(spark, args.input, contract, bool(args.multi_line))
        print("\n".join(lines))
        return 0 if passed else 1
    if args.job == "bronze":
        print(json.dumps(sinks.publish_bronze(files.scan_raw(spark, args.raw), args.lake, args.batch_id)))
    elif args.job == "layers":
        built = build_layers(spark, args.raw, args.lake, args.batch_id, multi_line=bool(args.multi_line))
        print(json.dumps({"batch_id": built.batch_id, "tables": built.tables, "manifest": built.manifest_path}))
    elif args.job == "silver":
        print(json.dumps({table: bronze_to_silver(spark, args.lake, table) for table in PRIMARY_KEYS}))
    elif args.job == "gold":
        silver_to_gold(spark, args.lake)
    elif args.job == "load":
        sinks.load_warehouse(spark, args.raw, bool(args.multi_line)).show(truncate=False)
        if args.audit:
            sinks.load_table(sinks.load_audit(spark, args.audit), "ai_copilot_audit")
    elif args.job == "marts":
        warehouse.build_marts(spark)
    elif args.job == "test":
        results = warehouse.run_tests(spark).orderBy("passed", "model", "test_name").collect()
        for row in results:
            print("PASS" if row["passed"] else "FAIL", row["test_name"], row["failures"])
        return 0 if all(row["passed"] for row in results) else 1
    elif args.job == "publish":
        header = spark.read.options(header=True, escape='"').csv(args.input).schema
        options = {"header": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
        stream = spark.readStream.schema(header).options(**options).csv(args.input)
        suspicious.publish_to_files(
            suspicious.suspicious_events(stream), args.output, args.checkpoint
        ).awaitTermination()
    elif args.job == "consume":
        events = suspicious.events_from_files(spark, args.input)
        if args.dead_letters:
            messages = suspicious.messages_from_files(spark, args.input)
            events = suspicious.parsed_messages(messages, strict=False)
            suspicious.keep_dead_letters(messages, args.dead_letters, f"{args.checkpoint}-dead-letters").awaitTermination()
        suspicious.maintain_summary(
            suspicious.unique_events(events) if args.unique else events, args.output, args.checkpoint,
            once=args.interval is None, interval=args.interval or "",
        ).awaitTermination()
    elif args.job == "unique":
        rows, repeated = staged(files.scan_csv(spark, args.input, bool(args.multi_line)), "unique"), 0
        for column in read_contract(spark, args.contract).unique:
            if column in rows.columns:
                report = key_index.check_batch(rows, column, args.batch_id, f"{args.index}/{column}")
                repeated += (found := report.agg(F.coalesce(F.sum("duplicates"), F.lit(0))).first()[0])
                print(f"{column}: {found} repeated")
        return 1 if repeated else 0
    elif args.job == "index":
        replace_table(keyword_blocks(read_corpus(spark, args.corpus)), args.index, options=KEPT)
    elif args.job == "ask":
        questions = spark.read.text(args.questions).withColumnRenamed("value", "question")
        sinks.append_audit(copilot.audit_records(answers_of(spark, questions, args)), args.audit)
    elif args.job == "evals":
        cases = read_cases(spark, args.cases)
        answers = answers_of(spark, cases.select("question").distinct(), args)
        results = copilot.eval_results(cases, answers)
        for row in results.where("NOT passed").orderBy("id").toLocalIterator():
            print("FAIL", f"{row['id']}: {row['details']}")
        totals = copilot.eval_summary(results).first()
        print(f"Summary: {totals['passed']}/{totals['total']} passed")
        return 0 if totals["failed"] == 0 else 1
    return 0


def main() -> int:
    args = parser().parse_args()
    return run(tune(SparkSession.builder.appName(f"riskloom-{args.job}").getOrCreate()), args)


if __name__ == "__main__":
    sys.exit(main())
