"""Every named query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import guard, rules, text
from riskloom.operators import checks, contracts, dedupe, keyword_index, retrieval, vector_index
from riskloom.operators.sizing import spread
from riskloom.plans import copilot, gold, layers, marts, serving, silver, staging, states
from riskloom.schemas import CONTRACTS, EVENT, MODEL_TESTS, ModelTests
from riskloom.session import scratch_path, staged, tune
from riskloom.sources import corpus_index, files, key_index, sinks
from riskloom.sources.samples import Samples
from riskloom.streaming import suspicious

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

STAMP = "2026-01-01T00:00:00+00:00"
BATCH = "2026-01-01T00-00-00Z"
AS_OF = "2024-01-10"


def query(fn: Callable[[Samples], DataFrame]) -> Callable[[Samples], DataFrame]:
    """Register a function of the sample tables under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Samples(tune(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def _texts(df: DataFrame) -> DataFrame:
    """Every column as text, as a CSV holds it."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# Entities through their staging models.


def customers(s: Samples) -> DataFrame:
    return staging.stg_customers(s["v_customers"])


def accounts(s: Samples) -> DataFrame:
    return staging.stg_accounts(s["v_accounts"])


def loans(s: Samples) -> DataFrame:
    return staging.stg_loans(s["v_loans"])


def transactions(s: Samples) -> DataFrame:
    return staging.stg_transactions(s["v_transactions"])


def macro(s: Samples) -> DataFrame:
    return staging.stg_macro_indicators(s["v_macro_indicators"])


def audit_lines(s: Samples) -> DataFrame:
    cited = F.array_compact(F.array("citation_1", "citation_2"))
    return s["feed_audit"].withColumn("citations", cited).select(
        "timestamp", "status", "question", "citations", "guarded_sql", "response"
    )


def audit(s: Samples) -> DataFrame:
    return marts.mart_ai_copilot_audit(staging.stg_ai_copilot_audit(files.audit_rows(audit_lines(s))))


def exposure(s: Samples) -> DataFrame:
    return marts.mart_customer_exposure(customers(s), loans(s))


def daily(s: Samples) -> DataFrame:
    return marts.mart_daily_transactions(transactions(s))


def health(s: Samples) -> DataFrame:
    return marts.mart_account_health(accounts(s), customers(s))


# Sources and sinks.


@query
def scan_csv_raw(s: Samples) -> DataFrame:
    raw = scratch_path(s.spark, "raw")
    sinks.write_csv(_texts(s["v_customers"]), f"{raw}/customers.csv")
    return files.scan_raw(s.spark, raw)["customers"]


@query
def scan_csv_quoted(s: Samples) -> DataFrame:
    """Fields with quotes, separators, line breaks and backslashes, written and read back."""
    path = scratch_path(s.spark, "quoted")
    quoted = F.concat(F.lit('say "'), F.col("source"), F.lit('", then C:\\dir\\'), F.lit("\n"), F.col("text"))
    rows = s["documents"].select(F.col("doc_id").cast("string").alias("doc_id"), quoted.alias("note"))
    sinks.write_csv(rows, path)
    read = files.scan_csv(s.spark, path, multi_line=True)
    return read.select("doc_id", F.md5(F.col("note").cast("binary")).alias("digest"))


@query
def load_row_counts(s: Samples) -> DataFrame:
    raw = scratch_path(s.spark, "raw")
    for name in ("customers", "accounts", "transactions", "loans", "macro_indicators"):
        sinks.write_csv(_texts(s[f"v_{name}"]), f"{raw}/{name}.csv")
    return sinks.row_counts(files.scan_core(s.spark, raw))


@query
def scan_layer(s: Samples) -> DataFrame:
    lake = scratch_path(s.spark, "lake")
    sinks.write_batch(s["v_accounts"], lake, "bronze", "accounts", BATCH)
    return files.scan_layer(s.spark, lake, "bronze", "accounts").where(F.col("batch_id") == BATCH)


@query
def layer_manifest(s: Samples) -> DataFrame:
    lake = scratch_path(s.spark, "lake")
    sinks.publish_bronze({"accounts": s["v_accounts"], "transactions": s["v_transactions"]}, lake, BATCH)
    sinks.write_batch(silver.standardize(s["v_accounts"], STAMP), lake, "silver", "accounts", BATCH)
    manifest = sinks.layer_manifest(
        s.spark, lake, BATCH, {"bronze": ["accounts", "transactions"], "silver": ["accounts"]}
    )
    return manifest.groupBy("batch_id", "layer", "table_name").agg(F.sum("row_count").alias("row_count"))


@query
def publish_bronze(s: Samples) -> DataFrame:
    lake = scratch_path(s.spark, "lake")
    for batch in (BATCH, BATCH.replace("2026", "2027"), BATCH):
        sinks.publish_bronze({"transactions": s["feed_transactions"]}, lake, batch)
    published = files.scan_layer(s.spark, lake, "bronze", "transactions")
    return published.groupBy("batch_id", "channel").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("transaction_id").alias("ids")
    )


def _built_layers(s: Samples) -> str:
    """A lake with one batch of every layer, built from CSV files of the raw tables."""
    raw, lake = scratch_path(s.spark, "raw"), scratch_path(s.spark, "lake")
    tables = {"customers": s["v_customers"], "loans": s["v_loans"], "transactions": s["feed_transactions"]}
    for name, df in tables.items():
        sinks.write_csv(_texts(df), f"{raw}/{name}.csv")
    layers.build_layers(s.spark, raw, lake, BATCH, datetime(2026, 1, 1, tzinfo=UTC))
    return lake


@query
def layers_gold_snapshot(s: Samples) -> DataFrame:
    return files.scan_layer(s.spark, _built_layers(s), "gold", "customer_credit_snapshot").drop("batch_id")


@query
def layers_gold_monitoring(s: Samples) -> DataFrame:
    return files.scan_layer(s.spark, _built_layers(s), "gold", "daily_transaction_monitoring").drop("batch_id")


@query
def layers_silver_loans(s: Samples) -> DataFrame:
    return files.scan_layer(s.spark, _built_layers(s), "silver", "loans")


@query
def event_jsonl(s: Samples) -> DataFrame:
    path = suspicious.write_event_batch(s["feed_transactions"], scratch_path(s.spark, "events"), BATCH)
    schema = EVENT.replace("timestamp string", "batch_id string")
    return files.scan_jsonl(s.spark, path, schema)


@query
def scan_register(s: Samples) -> DataFrame:
    path = scratch_path(s.spark, "register")
    landed = s["feed_register"].withColumn("DENOM_SOCIAL", F.concat("DENOM_SOCIAL", F.lit(" Ações")))
    sinks.write_csv(landed, path, sep=";", encoding="ISO-8859-1")
    return files.normalize_register(files.scan_register(s.spark, path))


@query
def index_corpus(s: Samples) -> DataFrame:
    path = scratch_path(s.spark, "index")
    vectors = s["embeddings"].select("vec_id", F.col("embedding").alias("vector"))
    texts = s["documents"].select(F.col("doc_id").alias("vec_id"), "source", "text")
    documents = texts.join(vectors, "vec_id", "left")
    sinks.index_corpus(documents, path)
    sinks.index_corpus(documents.where("false"), path)
    index = s.spark.read.parquet(path)
    return index.select("vec_id", "source", F.size("vector").alias("dims"), F.length("text").alias("chars"))


@query
def index_corpus_changes(s: Samples) -> DataFrame:
    """An index after a tenth of its documents was removed, a tenth was changed and as many came in, and the work it took."""
    path = scratch_path(s.spark, "index")
    texts = s["documents"].select(F.col("doc_id").alias("vec_id"), "source", "text")
    vectors = s["embeddings"].select("vec_id", F.col("embedding").alias("vector"))
    corpus_index.update_index(texts, path, lambda rows: rows.join(vectors, "vec_id", "left"))
    kind = F.col("vec_id") % 10
    changed = F.when(kind == 1, F.concat("text", F.lit("+"))).otherwise(F.col("text"))
    came = texts.where(kind == 2).withColumn("vec_id", -F.col("vec_id"))
    now = texts.where(kind != 0).withColumn("text", changed).unionByName(came)
    corpus_index.update_index(now, path, lambda rows: rows.withColumn("vector", F.array(F.lit(0).cast("float"))))
    index = corpus_index.read_index(s.spark, path)
    return index.select("vec_id", "source", F.size("vector").alias("dims"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def scan_csv_numbered(s: Samples) -> DataFrame:
    """Rows with line breaks in their fields, by their place in the files."""
    path = scratch_path(s.spark, "numbered")
    rows = s["documents"].select(F.col("doc_id").cast("string").alias("doc_id"), F.concat("text", F.lit("\n\"")).alias("note"))
    sinks.write_csv_in_order(rows, F.col("doc_id").cast("bigint"), path)
    read = files.scan_csv_numbered(s.spark, path, multi_line=True)
    return read.select("row_id", "doc_id", F.md5(F.col("note").cast("binary")).alias("digest"))


@query
def unique_across_batches(s: Samples) -> DataFrame:
    """The customers that several of three batches of accounts hold, or one holds more than once."""
    path, found = scratch_path(s.spark, "unique"), []
    for k in range(3):
        rows = s["v_accounts"].where(F.col("account_id") % 3 == k)
        report = key_index.check_batch(rows, "customer_id", f"b{k}", path)
        found.append(report.withColumn("batch_id", F.lit(f"b{k}")))
    return reduce(DataFrame.unionByName, found)


@query
def scan_jsonl_audit(s: Samples) -> DataFrame:
    path = scratch_path(s.spark, "audit")
    sinks.append_audit(audit_lines(s), path)
    lines = files.scan_jsonl(s.spark, path)
    return lines.select("timestamp", "status", "question", F.size("citations").alias("n_citations"), "guarded_sql",
                        "response")


@query
def audit_load(s: Samples) -> DataFrame:
    path = scratch_path(s.spark, "audit")
    sinks.append_audit(audit_lines(s), path)
    return sinks.load_audit(s.spark, path)


@query
def corpus_scan(s: Samples) -> DataFrame:
    return retrieval.corpus_documents(s["feed_files"], files.CORPUS_EXTENSIONS)


@query
def cvm_normalize(s: Samples) -> DataFrame:
    return files.normalize_register(s["feed_register"])


@query
def bcb_normalize(s: Samples) -> DataFrame:
    return files.normalize_series(s["feed_series"].where("indicator_name = 'selic'"), "selic")


@query
def scan_series(s: Samples) -> DataFrame:
    """A series that landed as one JSON array a month."""
    path = scratch_path(s.spark, "series")
    landed = s["feed_series"].where("indicator_name = 'selic'").withColumn("month", F.substring("data", 4, 7))
    arrays = landed.groupBy(F.replace("month", F.lit("/"), F.lit("-")).alias("month")).agg(
        F.to_json(F.collect_list(F.struct("data", "valor"))).alias("value"))
    arrays.write.partitionBy("month").text(path)
    return files.normalize_series(files.scan_series(s.spark, path), "selic")


@query
def cvm_first_rows(s: Samples) -> DataFrame:
    return files.normalize_register(s["feed_register"], max_rows=40)


@query
def overwrite_layer(s: Samples) -> DataFrame:
    """A layer table replaced by one with other columns."""
    path = scratch_path(s.spark, "layer")
    sinks.overwrite_layer(s["v_accounts"], path)
    sinks.overwrite_layer(s["v_accounts"].select("account_id", F.upper("account_type").alias("kind")), path)
    return files.read_layer_table(s.spark, path)


@query
def corpus_files(s: Samples) -> DataFrame:
    """Documents per file folder: one JSON file and its lines for each source."""
    path = scratch_path(s.spark, "corpus")
    documents = s["documents"].select("source", "doc_id", "text")
    documents.repartition("source").write.partitionBy("source").json(path)
    found = files.scan_corpus(s.spark, [path])
    lines = F.size(F.split("text", "\n")) - 1
    folder = F.regexp_extract("source", "source=([^/]+)/", 1)
    return found.select(folder.alias("folder"), lines.alias("lines")).groupBy("folder").agg(
        F.sum("lines").alias("documents"))


@query
def macro_union(s: Samples) -> DataFrame:
    series = s["feed_series"]
    return files.union_series({name: series.where(F.col("indicator_name") == name) for name in files.SERIES_IDS})


# Staging.


@query
def stg_customers(s: Samples) -> DataFrame:
    return staging.stg_customers(_texts(s["v_customers"]))


@query
def stg_accounts(s: Samples) -> DataFrame:
    return staging.stg_accounts(_texts(s["v_accounts"]))


@query
def stg_transactions(s: Samples) -> DataFrame:
    return staging.stg_transactions(_texts(s["v_transactions"]))


@query
def stg_loans(s: Samples) -> DataFrame:
    return staging.stg_loans(_texts(s["v_loans"]))


@query
def stg_macro_indicators(s: Samples) -> DataFrame:
    return staging.stg_macro_indicators(_texts(s["v_macro_indicators"]))


@query
def stg_ai_copilot_audit(s: Samples) -> DataFrame:
    return _iso(staging.stg_ai_copilot_audit(files.audit_rows(audit_lines(s))))


def _iso(df: DataFrame) -> DataFrame:
    """Audit time as text, which reads the same in both engines."""
    return df.withColumn("audit_timestamp", F.date_format("audit_timestamp", "yyyy-MM-dd HH:mm:ss"))


# Silver.


def _bronze(s: Samples, name: str) -> DataFrame:
    """Raw rows under untidy names, each row twice."""
    once = _texts(s[f"v_{name}"])
    untidy = once.toDF(*[f" {c.title()} " for c in once.columns])
    return untidy.unionAll(untidy)


def _silver(s: Samples, name: str, keys: list[str]) -> DataFrame:
    return silver.to_silver(_bronze(s, name), keys, silver.CLEANERS[name], F.lit(STAMP))


@query
def silver_standardize(s: Samples) -> DataFrame:
    return silver.standardize(_bronze(s, "customers"), STAMP)


@query
def silver_transactions(s: Samples) -> DataFrame:
    return _silver(s, "transactions", ["transaction_id"])


@query
def silver_customers(s: Samples) -> DataFrame:
    return _silver(s, "customers", ["customer_id"])


@query
def silver_loans(s: Samples) -> DataFrame:
    return _silver(s, "loans", ["loan_id"])


@query
def silver_accounts(s: Samples) -> DataFrame:
    return _silver(s, "accounts", ["account_id"])


@query
def silver_newest(s: Samples) -> DataFrame:
    """Silver of two Bronze batches that hold different versions of every account, the older one last."""
    lake = scratch_path(s.spark, "lake")
    raw = _texts(s["v_accounts"])
    older = raw.withColumn("status", F.lit("BLOCKED"))
    sinks.write_batch(raw.where("account_id % 5 <> 0"), lake, "bronze", "accounts", "2026-02-01T00-00-00Z")
    sinks.write_batch(older, lake, "bronze", "accounts", "2026-01-01T00-00-00Z")
    layers.bronze_to_silver(s.spark, lake, "accounts")
    return files.scan_layer(s.spark, lake, "silver_typed", "accounts").drop("ingestion_processed_at")


@query
def silver_incremental(s: Samples) -> DataFrame:
    """Silver kept up to date over three runs: every account, a newer version of some, and a late older one of all."""
    lake = scratch_path(s.spark, "lake")
    raw = _texts(s["v_accounts"])
    for batch, rows in (("2026-02-01", raw.withColumn("status", F.lit("BLOCKED"))), ("2026-03-01", raw.where("account_id % 5 <> 0")),
                        ("2026-01-01", raw.withColumn("status", F.lit("CLOSED")))):
        sinks.write_batch(rows, lake, "bronze", "accounts", f"{batch}T00-00-00Z")
        layers.bronze_to_silver(s.spark, lake, "accounts")
    return files.scan_layer(s.spark, lake, "silver_typed", "accounts").drop("ingestion_processed_at")


@query
def silver_macro(s: Samples) -> DataFrame:
    return _silver(s, "macro_indicators", ["observation_date", "indicator_name"])


def _dated(lines: DataFrame) -> DataFrame:
    """All columns of the order lines, the ship date as a date."""
    return lines.withColumn("l_shipdate", F.to_date("l_shipdate"))


@query
def silver_dedup_pk(s: Samples) -> DataFrame:
    return _dated(dedupe.one_per_key(s["lineitem"], ["l_orderkey", "l_linenumber"]))


@query
def silver_dedup_rows(s: Samples) -> DataFrame:
    return _dated(dedupe.distinct_rows(s["lineitem"].unionAll(s["lineitem"])))


@query
def silver_dedup_latest(s: Samples) -> DataFrame:
    newest = [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_extendedprice")]
    return _dated(dedupe.latest_per_key(s["lineitem"], ["l_orderkey", "l_linenumber"], newest))


# Gold.


@query
def gold_customer_credit_snapshot(s: Samples) -> DataFrame:
    # One row per loan and per transaction, as Silver has them.
    return gold.gold_customer_credit_snapshot(customers(s), loans(s), unique_ids=True)


@query
def local_customer_credit_snapshot(s: Samples) -> DataFrame:
    return gold.local_customer_credit_snapshot(_texts(s["v_customers"]), gold.for_gold(_texts(s["v_loans"])))


@query
def gold_daily_transaction_monitoring(s: Samples) -> DataFrame:
    return gold.gold_daily_transaction_monitoring(transactions(s), unique_ids=True)


@query
def local_daily_transaction_monitoring(s: Samples) -> DataFrame:
    return gold.local_daily_transaction_monitoring(gold.for_gold(s["feed_transactions"]))


# Marts from states of batches.


def _states(s: Samples, name: str, raw: DataFrame, key: str) -> DataFrame:
    """The states of two batches, the first of which came in wrong and was corrected."""
    lake, table = scratch_path(s.spark, "lake"), states.STATES[name].table
    first = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    wrong = raw.where(first).unionAll(raw).withColumn(key, F.concat(F.lit("x"), F.col(key)))
    for batch, rows in (("b1", wrong), ("b2", raw.where(~first)), ("b1", raw.where(first))):
        sinks.write_batch(rows, lake, "bronze", table, batch)
        states.update_states(s.spark, lake, name)
    return states.read_states(s.spark, lake, name)


@query
def states_daily_transactions(s: Samples) -> DataFrame:
    found = _states(s, "daily_transactions", _texts(s["v_transactions"]), "transaction_id")
    return states.daily_transactions(found)


@query
def states_daily_monitoring(s: Samples) -> DataFrame:
    return states.daily_monitoring(_states(s, "daily_monitoring", s["feed_transactions"], "transaction_id"))


@query
def states_customer_exposure(s: Samples) -> DataFrame:
    found = _states(s, "customer_loans", _texts(s["v_loans"]), "loan_id")
    return states.customer_exposure(customers(s), found)


# Intermediate models and marts.


@query
def int_customer_credit_profile(s: Samples) -> DataFrame:
    return marts.int_customer_credit_profile(customers(s), loans(s))


@query
def mart_customer_exposure(s: Samples) -> DataFrame:
    return exposure(s)


@query
def mart_daily_transactions(s: Samples) -> DataFrame:
    return daily(s)


@query
def mart_account_health(s: Samples) -> DataFrame:
    return health(s)


@query
def int_credit_macro_context(s: Samples) -> DataFrame:
    return marts.int_credit_macro_context(macro(s))


@query
def macro_latest(s: Samples) -> DataFrame:
    return marts.macro_latest(macro(s))


@query
def mart_credit_macro_context(s: Samples) -> DataFrame:
    return marts.mart_credit_macro_context(macro(s), exposure(s))


@query
def mart_ai_copilot_audit(s: Samples) -> DataFrame:
    return _iso(audit(s))


@query
def loan_risk_rating(s: Samples) -> DataFrame:
    return s["v_scored_loans"].select(
        "loan_id", rules.risk_rating(F.col("days_past_due"), F.col("internal_score")).alias("risk_rating")
    )


@query
def status_labels(s: Samples) -> DataFrame:
    code = F.col("status")
    return accounts(s).select(
        "account_id", rules.label_for(code, {"ACTIVE": "Active", "BLOCKED": "Blocked"}).alias("status_label")
    )


# Contracts.

FEEDS = {
    "accounts": "feed_accounts", "customers": "feed_customers", "cvm_funds": "feed_register", "loans": "feed_loans",
    "transactions": "feed_transactions",
}


def _feeds(s: Samples) -> dict[str, DataFrame]:
    """The raw feeds by contract; the register under its normalised names."""
    feeds = {name: s[view] for name, view in FEEDS.items()}
    register = feeds["cvm_funds"]
    feeds["cvm_funds"] = register.withColumnsRenamed(files.REGISTER_COLUMNS)
    return feeds


def _over_feeds(s: Samples, fn: Callable[[DataFrame, contracts.Contract], DataFrame]) -> DataFrame:
    parts = [fn(df, CONTRACTS[name]) for name, df in _feeds(s).items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


@query
def contract_required_columns(s: Samples) -> DataFrame:
    return _over_feeds(s, contracts.required_columns)


@query
def contract_not_null(s: Samples) -> DataFrame:
    return _over_feeds(s, contracts.not_null_counts)


@query
def contract_unique(s: Samples) -> DataFrame:
    def repeats(df: DataFrame, contract: contracts.Contract) -> DataFrame:
        parts = [
            contracts.duplicate_rows(df, column, "row_id").select(
                F.lit(contract.name).alias("contract"), F.lit(column).alias("column_name"), "row_id", "value")
            for column in contract.unique
        ]
        return reduce(DataFrame.unionByName, parts)

    return _over_feeds(s, repeats)


@query
def contract_summary(s: Samples) -> DataFrame:
    return _over_feeds(s, contracts.summary)


@query
def contract_errors(s: Samples) -> DataFrame:
    return _over_feeds(s, lambda df, contract: contracts.first_errors(df, contract, "row_id"))


# Data tests.


@query
def dq_unique(s: Samples) -> DataFrame:
    parts = [
        checks.run_model_tests(s[f"feed_{name}"], ModelTests(name, unique=key))
        for name, key in (("transactions", "transaction_id"), ("loans", "loan_id"), ("accounts", "account_id"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dq_not_null(s: Samples) -> DataFrame:
    customers_test = checks.run_model_tests(
        s["feed_customers"], ModelTests("customers", not_null=("customer_id", "state"))
    )
    return customers_test.unionByName(
        checks.run_model_tests(s["feed_accounts"], ModelTests("accounts", not_null=("account_id", "status")))
    )


@query
def dq_accepted_values(s: Samples) -> DataFrame:
    tested = ModelTests("accounts", accepted={
        "status": MODEL_TESTS["stg_accounts"].accepted["status"], "account_type": ("CHECKING", "SAVINGS"),
    })
    return checks.run_model_tests(s["feed_accounts"], tested)


def _rule(s: Samples, df: DataFrame, model: str, rule: str) -> DataFrame:
    failing = F.expr(MODEL_TESTS[model].rules[rule])
    return df.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(failing).alias("failures"))


@query
def dq_exposure_non_negative(s: Samples) -> DataFrame:
    return _rule(s, exposure(s), "mart_customer_exposure", "customer_exposure_non_negative")


@query
def dq_no_future_transactions(s: Samples) -> DataFrame:
    late = checks.no_future_rows(transactions(s), "transaction_date", F.lit(AS_OF).cast("date"))
    return late.groupBy("transaction_date").agg(F.count(F.lit(1)).alias("failures"))


@query
def dq_status_matches_dpd(s: Samples) -> DataFrame:
    # The Gold snapshot follows other bands, so the mart's rule finds the customers on which the two differ.
    snapshot = gold.gold_customer_credit_snapshot(customers(s), loans(s), unique_ids=True)
    return _rule(s, snapshot, "mart_customer_exposure", "portfolio_status_matches_dpd")


@query
def dq_suspicious_within_total(s: Samples) -> DataFrame:
    return _rule(s, daily(s), "mart_daily_transactions", "suspicious_count_within_transaction_count")


@query
def dq_referential(s: Samples) -> DataFrame:
    return checks.orphans(s["feed_accounts"], _texts(s["v_customers"]), "customer_id")


@query
def dq_suite_report(s: Samples) -> DataFrame:
    # Two marts read the exposure, so it is built once, as a warehouse does.
    built = staged(exposure(s), "exposure")
    models = {
        "stg_customers": customers(s), "stg_transactions": transactions(s), "stg_loans": loans(s),
        "stg_macro_indicators": macro(s), "stg_accounts": accounts(s), "mart_customer_exposure": built,
        "mart_daily_transactions": daily(s),
        "mart_credit_macro_context": marts.mart_credit_macro_context(macro(s), built),
        "mart_ai_copilot_audit": audit(s), "mart_account_health": health(s),
    }
    return checks.run_suite(models, MODEL_TESTS)


# Streaming.


@query
def suspicious_filter(s: Samples) -> DataFrame:
    return suspicious.suspicious_only(s["feed_transactions"]).select("row_id", "customer_id", "is_suspicious")


@query
def suspicious_events(s: Samples) -> DataFrame:
    return suspicious.suspicious_event_batch(s["v_transactions"], BATCH)


def _transaction_stream(s: Samples) -> DataFrame:
    """The transactions as a stream over the events file."""
    stream = (
        s.spark.readStream.schema(s["events"].schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(s.sf_dir)
    )
    return Samples(s.spark, s.sf_dir, events=stream)["v_transactions"]


def _summary(s: Samples) -> DataFrame:
    """Running totals after the event stream over the events file has been drained."""
    events = suspicious.suspicious_only(_transaction_stream(s)).withColumn(
        "timestamp", F.lit(None).cast("string")
    )
    path = scratch_path(s.spark, "summary")
    job = suspicious.maintain_summary(events, path, scratch_path(s.spark, "summary-checkpoint"))
    job.awaitTermination()
    return suspicious.read_summary(s.spark, path)


@query
def suspicious_event_stream(s: Samples) -> DataFrame:
    path = scratch_path(s.spark, "events")
    events = suspicious.suspicious_events(_transaction_stream(s))
    suspicious.publish_to_files(events, path, scratch_path(s.spark, "events-checkpoint")).awaitTermination()
    return files.scan_jsonl(s.spark, path, EVENT).drop("timestamp")


@query
def streaming_suspicious_summary(s: Samples) -> DataFrame:
    return _summary(s)


@query
def streaming_replayed_events(s: Samples) -> DataFrame:
    """Running totals where every event file is delivered twice, in as many micro-batches as there are files."""
    path = scratch_path(s.spark, "events")
    events = suspicious.suspicious_events(s["v_transactions"]).withColumn("timestamp", F.lit(None).cast("string"))
    events = staged(events.repartition(3, "transaction_id"), "events")
    for _ in range(2):
        events.write.mode("append").json(path)
    stream = suspicious.unique_events(suspicious.events_from_files(s.spark, path, 2))
    summary = scratch_path(s.spark, "summary")
    suspicious.maintain_summary(stream, summary, scratch_path(s.spark, "summary-checkpoint")).awaitTermination()
    return suspicious.read_summary(s.spark, summary)


@query
def streaming_alert_kpis(s: Samples) -> DataFrame:
    return serving.streaming_alert_kpis(_summary(s))


@query
def top_flagged_customers(s: Samples) -> DataFrame:
    events = suspicious.suspicious_events(s["v_transactions"], F.lit(STAMP).cast("timestamp"))
    return serving.top_flagged_customers(suspicious.running_totals(events))


# Retrieval and governance.


def corpus(s: Samples) -> DataFrame:
    return spread(s["v_corpus"], "source")


@query
def corpus_token_counts(s: Samples) -> DataFrame:
    words = corpus(s).select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


@query
def compact_text(s: Samples) -> DataFrame:
    return corpus(s).select("source", text.compact(F.col("text")).alias("compact"))


@query
def retrieve_keyword_topk(s: Samples) -> DataFrame:
    return retrieval.keyword_topk(s["feed_questions"], corpus(s), 4)


@query
def keyword_index_terms(s: Samples) -> DataFrame:
    """What a kept keyword index knows of its terms."""
    path = scratch_path(s.spark, "keywords")
    keyword_index.write_blocks(keyword_index.keyword_blocks(corpus(s)), path)
    return keyword_index.index_terms(s.spark.read.parquet(path))


@query
def retrieve_keyword_index(s: Samples) -> DataFrame:
    """The best documents of every question by a kept index, with the questions in several parts."""
    path = scratch_path(s.spark, "keywords")
    keyword_index.write_blocks(keyword_index.keyword_blocks(corpus(s)), path)
    return keyword_index.search_keywords(s["feed_questions"], s.spark.read.parquet(path), 4, part=1_000)


@query
def retrieve_context(s: Samples) -> DataFrame:
    return retrieval.retrieve_context(s["feed_questions"], corpus(s), 4)


def _mean_vectors(s: Samples) -> tuple[DataFrame, DataFrame]:
    """The mean vector of each label, rounded so that the order of summing does not show, and all vectors."""
    vectors = s["embeddings"].select("vec_id", F.col("embedding").alias("vector"), "label")
    parts = vectors.select("label", F.posexplode("vector").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    queries = means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector")
    )
    return queries, vectors


@query
def retrieve_vector_topk(s: Samples) -> DataFrame:
    return retrieval.vector_topk(*_mean_vectors(s), 3)


@query
def retrieve_vector_index(s: Samples) -> DataFrame:
    """The nearest vectors by a kept index of more cells than the table needs, with the queries in several parts."""
    queries, vectors = _mean_vectors(s)
    path = scratch_path(s.spark, "vectors")
    vector_index.vector_packs(vectors, cells=64).write.parquet(path)
    return vector_index.search_vectors(queries, s.spark.read.parquet(path), 3, part=4)


@query
def guardrail_classify(s: Samples) -> DataFrame:
    judged = guard.guard(s["feed_statements"], "sql", ("analytics_marts",), 100)
    return judged.select("statement_id", "guarded_sql", "reason")


@query
def guardrail_limit(s: Samples) -> DataFrame:
    return s["feed_statements"].select(
        "statement_id", guard.enforce_limit(text.squeeze(F.col("sql")), guard.DEFAULT_LIMIT).alias("limited_sql")
    )


@query
def question_screen(s: Samples) -> DataFrame:
    return s["feed_questions"].select("question_id", copilot.is_destructive(F.col("question")).alias("destructive"))


@query
def question_route(s: Samples) -> DataFrame:
    return s["feed_questions"].select("question_id", copilot.canned_sql(F.col("question")).alias("draft_sql"))


@query
def answer_compose(s: Samples) -> DataFrame:
    cited = F.array_compact(F.array("citation_1", "citation_2"))
    return s["feed_audit"].select(
        "audit_id", copilot.compose(cited, F.col("guarded_sql"), "Risk desk").alias("response")
    )


def _answers(s: Samples) -> DataFrame:
    return copilot.answer_batch(s["feed_questions"], corpus(s), name="Risk desk")


@query
def copilot_audit_batch(s: Samples) -> DataFrame:
    return _answers(s).select(
        "question_id", "status", "question", F.array_join("citations", ", ").alias("citations"), "guarded_sql",
        "response",
    )


def _eval_results(s: Samples) -> DataFrame:
    asked = s["feed_questions"]
    opening = F.when(copilot.is_destructive(F.col("question")), "Cannot run").otherwise("Governed Offline Mode")
    last_word = F.when(F.col("question_id") % 2 == 0, F.element_at(F.split("question", " "), -1))
    cases = asked.select(
        F.col("question_id").alias("id"), "question",
        F.array_compact(F.array(opening, last_word)).alias("expected_terms"),
        F.col("question").contains("account").alias("requires_sql"),
    )
    answers = copilot.answer_batch(asked.select("question").distinct(), corpus(s), name="Risk desk")
    return copilot.eval_results(cases, answers)


@query
def eval_results(s: Samples) -> DataFrame:
    return _eval_results(s)


@query
def eval_summary(s: Samples) -> DataFrame:
    return copilot.eval_summary(_eval_results(s))


@query
def guarded_query(s: Samples) -> DataFrame:
    return copilot.run_guarded(s.spark, copilot.EXPOSURE_BY_SEGMENT, marts={"mart_customer_exposure": exposure(s)})


@query
def copilot_exposure_by_segment(s: Samples) -> DataFrame:
    return copilot.exposure_by_segment(exposure(s))


@query
def copilot_suspicious_by_channel(s: Samples) -> DataFrame:
    return copilot.suspicious_by_channel(daily(s))


@query
def copilot_exposure_by_status(s: Samples) -> DataFrame:
    return copilot.exposure_by_status(exposure(s))


@query
def copilot_account_health(s: Samples) -> DataFrame:
    return copilot.health_summary(health(s))


# Serving.


@query
def kpi_exposure(s: Samples) -> DataFrame:
    return serving.kpi_exposure(exposure(s))


@query
def exposure_by_segment_status(s: Samples) -> DataFrame:
    return serving.exposure_by_segment_status(exposure(s))


@query
def exposure_share_by_status(s: Samples) -> DataFrame:
    return serving.exposure_share_by_status(exposure(s))


@query
def daily_totals(s: Samples) -> DataFrame:
    return serving.daily_totals(daily(s))


@query
def daily_suspicious_scaled(s: Samples) -> DataFrame:
    return serving.daily_suspicious_scaled(daily(s))


@query
def kpi_account_health(s: Samples) -> DataFrame:
    return serving.kpi_account_health(health(s))


@query
def health_by_segment(s: Samples) -> DataFrame:
    return serving.health_by_segment(health(s))


@query
def health_share(s: Samples) -> DataFrame:
    return serving.health_share(health(s))


@query
def active_ratio_by_state(s: Samples) -> DataFrame:
    return serving.active_ratio_by_state(health(s))


@query
def audit_kpis(s: Samples) -> DataFrame:
    return serving.audit_kpis(audit(s))


@query
def audit_by_status(s: Samples) -> DataFrame:
    return serving.audit_by_status(audit(s))


@query
def audit_recent(s: Samples) -> DataFrame:
    return _iso(serving.audit_recent(audit(s)))
