"""Every batch job by name, wired to the canonical views of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.text import iso_millis
from turnledger.plans import (
    clusters,
    customers,
    evaluation,
    index,
    judging,
    live,
    policy,
    readout,
    retrieval,
    runs,
    texts,
    traces,
    vectors,
)
from turnledger.schemas import CUSTOMERS_CONTEXT, EVAL_RUNS
from turnledger.session import configure
from turnledger.sources import canonical as c
from turnledger.sources import readers, sinks
from turnledger.streaming import backfill

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2024, 1, 31)
DRIFT_SPLIT = date(2024, 1, 16)

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a job under its function name, with the session settings applied."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


# --- traces -------------------------------------------------------------------


@query
def trace_list(s, d):
    return traces.trace_list(c.conversations(s, d))


@query
def conversation_rollup(s, d):
    return traces.collapse_summaries(c.summary_log(s, d)).withColumn("created_at", iso_millis("created_at"))


@query
def trace_events(s, d):
    return traces.event_report(traces.typed_events(c.trace_events(s, d)))


@query
def trace_events_full(s, d):
    full = traces.typed_events(c.trace_events(s, d), full=True)
    return full.groupBy("event_type").agg(
        F.count("*").alias("events"),
        F.sum("llm_input_tokens").alias("llm_input_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
    )


@query
def trace_detail(s, d):
    pages = traces.trace_documents(c.conversations(s, d), c.trace_events(s, d))
    lines = F.transform("events", lambda e: F.concat(e["event_type"], F.lit("@"), iso_millis(e["timestamp"])))
    return pages.withColumn("events", F.array_join(lines, "|"))


@query
def trace_timeline(s, d):
    return traces.trace_timeline(c.trace_events(s, d))


@query
def trace_cost(s, d):
    costs = traces.trace_costs(c.trace_events(s, d))
    return costs.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query
def retrieval_hits(s, d):
    return traces.retrieval_hits(c.trace_events(s, d))


@query
def contract_violations(s, d):
    return traces.contract_violations(c.conversations(s, d), c.trace_events(s, d))


@query
def quarantined_events(s, d):
    return traces.quarantined_events(c.trace_events(s, d))


@query
def undeclared_fields(s, d):
    return traces.undeclared_fields(c.trace_events(s, d))


@query
def load_counts(s, d):
    return traces.load_counts(
        {
            "conversations": c.conversations(s, d),
            "conversation_traces": c.trace_events(s, d),
            "customers_context": c.customers(s, d),
            "orders": c.orders(s, d),
            "eval_runs": _runs(s, d),
        }
    )


# --- customers and orders -------------------------------------------------------


@query
def customer_list(s, d):
    return customers.customer_list(c.customers(s, d))


@query
def recent_orders(s, d):
    return customers.recent_orders(c.orders(s, d)).select(
        "customer_id", "recency", "order_id", "status", iso_millis("order_date").alias("ordered_at")
    )


@query
def order_lookup(s, d):
    return customers.order_lookup(c.order_requests(s, d), c.orders(s, d))


@query
def order_lookup_strict(s, d):
    return customers.order_lookup(c.order_requests(s, d), c.orders(s, d), strict=True)


@query
def customer_context(s, d):
    return customers.customer_context(c.customers(s, d), c.orders(s, d), c.conversations(s, d))


@query
def customer_attach(s, d):
    rows = customers.attach_customer(c.conversations(s, d), c.customers(s, d))
    return rows.select("trace_id", "customer_id", "tier", "customer_label", "is_anonymous")


@query
def order_status_context(s, d):
    return customers.order_status_context(c.order_requests(s, d), c.orders_with_items(s, d))


# --- evaluation -------------------------------------------------------------------


def _golden(s: SparkSession, d: str) -> DataFrame:
    return evaluation.golden_results(
        c.eval_queries(s, d), c.eval_responses(s, d), c.trace_events(s, d), c.judge_texts(s, d)
    )


def _runs(s: SparkSession, d: str) -> DataFrame:
    return c.eval_runs(evaluation.run_rows(c.eval_results(s, d), ["run_id"]))


def _long(s: SparkSession, d: str) -> DataFrame:
    return runs.metrics_long(runs.run_list(_runs(s, d)))


@query
def golden_results(s, d):
    return _golden(s, d).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query
def golden_eval(s, d):
    return evaluation.run_rows(_golden(s, d), ["run_id"])


@query
def task_success(s, d):
    return evaluation.task_success(c.eval_results(s, d))


@query
def latency_percentiles(s, d):
    return evaluation.latency_percentiles(c.conversations(s, d), ["journey"], "latency_p50_ms")


@query
def judge_rates(s, d):
    return evaluation.judge_rates(_golden(s, d))


@query
def intent_confusion(s, d):
    return evaluation.intent_confusion(c.eval_results(s, d))


@query
def content_checks(s, d):
    return texts.content_checks(c.eval_queries(s, d), c.eval_responses(s, d))


@query
def judge_prompts(s, d):
    rows = c.eval_queries(s, d).join(c.eval_responses(s, d), "trace_id")
    return judging.judge_prompts(rows)


@query
def judge_parse(s, d):
    return judging.judge_parse(c.judge_texts(s, d))


@query
def judge_hook(s, d):
    rows = c.eval_queries(s, d).join(c.eval_responses(s, d), "trace_id")
    rows = rows.select("query_id", "utterance", "response_text", "expected_outcome", "journey")
    scored = judging.judge_with(rows, judging.keyword_judge)
    return scored.groupBy("journey", "task_success", "hallucinated").agg(
        F.count("*").alias("queries"), F.sum("judge_cost_usd").cast("double").alias("judge_cost_usd")
    )


def _sample(s: SparkSession, d: str, modality: str, **kw) -> DataFrame:
    return evaluation.production_sample(
        c.conversations(s, d), c.trace_events(s, d), _runs(s, d), modality, NOW, **kw
    )


@query
def production_sample(s, d):
    return _sample(s, d, "voice", sample_size=50).withColumn("created_at", iso_millis("created_at"))


@query
def production_sample_first(s, d):
    rows = _sample(s, d, "voice", sample_size=50, sample_first=True)
    return rows.withColumn("created_at", iso_millis("created_at"))


@query
def production_eval(s, d):
    results = evaluation.production_results(_sample(s, d, "all", sample_size=50), "evr_prod")
    return evaluation.production_run(results, "all")


@query
def batch_preview(s, d):
    return evaluation.batch_preview(c.conversations(s, d), _runs(s, d), ("voice", "chat", "all"), NOW)


@query
def stratified_sample(s, d):
    return evaluation.stratified_sample(c.conversations(s, d))


# --- runs -------------------------------------------------------------------------


@query
def eval_run_list(s, d):
    return runs.newest_first(_runs(s, d)).drop("created_at")


@query
def latest_run(s, d):
    return runs.latest_run(_runs(s, d))


@query
def eval_metrics_long(s, d):
    return _long(s, d).drop("created_at")


@query
def metric_trend(s, d):
    return runs.metric_trend(_long(s, d))


@query
def run_compare(s, d):
    base, new = runs.last_two(_runs(s, d))
    return runs.run_compare(_long(s, d), base, new)


@query
def metric_gate(s, d):
    return runs.metric_gate(_long(s, d))


# --- failures ---------------------------------------------------------------------


@query
def failure_clusters(s, d):
    return clusters.failure_clusters(_golden(s, d))


@query
def failure_examples(s, d):
    return clusters.failure_examples(_golden(s, d))


@query
def cluster_readout(s, d):
    rows = clusters.cluster_readout(c.conversations(s, d), c.trace_events(s, d))
    return rows.withColumn("sample_trace_ids", F.array_join("sample_trace_ids", ","))


@query
def cluster_drill(s, d):
    conversations = c.conversations(s, d)
    return clusters.cluster_drill(clusters.cluster_readout(conversations, c.trace_events(s, d)), conversations)


# --- policy -----------------------------------------------------------------------


@query
def policy_replay(s, d):
    return policy.policy_replay(c.conversations(s, d), c.trace_events(s, d))


@query
def policy_sweep(s, d):
    return policy.policy_sweep(c.conversations(s, d), c.trace_events(s, d))


@query
def verifier_rates(s, d):
    return policy.verifier_rates(c.trace_events(s, d))


@query
def escalation_reasons(s, d):
    return policy.escalation_reasons(c.trace_events(s, d), c.conversations(s, d))


@query
def failure_bursts(s, d):
    return policy.failure_bursts(c.service_signals(s, d)).withColumn("timestamp", iso_millis("timestamp"))


@query
def cost_ledger(s, d):
    return policy.cost_ledger(c.trace_events(s, d))


# --- readouts ---------------------------------------------------------------------


@query
def outcome_matrix(s, d):
    return readout.outcome_matrix(c.conversations(s, d))


@query
def outcome_windows(s, d):
    return readout.outcome_windows(c.conversations(s, d))


@query
def refusal_spikes(s, d):
    return readout.refusal_spikes(c.conversations(s, d))


@query
def refusal_alerts(s, d):
    return readout.refusal_alerts(c.conversations(s, d)).withColumn("window_start", iso_millis("window_start"))


@query
def latency_rolling(s, d):
    rows = readout.rolling_percentiles(readout.latency_sketches(c.conversations(s, d)))
    return rows.withColumn("window_start", iso_millis("window_start"))


@query
def conversation_kpis(s, d):
    return readout.conversation_kpis(c.conversations(s, d))


@query
def daily_cost(s, d):
    return readout.daily_cost(c.conversations(s, d))


@query
def business_readout(s, d):
    return readout.business_readout(c.conversations(s, d), _runs(s, d))


@query
def containment_sensitivity(s, d):
    return readout.containment_sensitivity(c.conversations(s, d))


@query
def intent_drift(s, d):
    return readout.intent_drift(c.conversations(s, d), DRIFT_SPLIT)


# --- texts ------------------------------------------------------------------------


@query
def pii_redaction(s, d):
    return texts.pii_redaction(c.passages(s, d), "passage_id", "content")


@query
def claims(s, d):
    return texts.claims(c.turns(s, d)).withColumn("claim_no", F.col("claim_no").cast("long"))


@query
def injection_flags(s, d):
    return texts.injection_flags(c.incoming_messages(s, d))


@query
def injection_families(s, d):
    return texts.injection_families(c.incoming_messages(s, d))


@query
def transcript(s, d):
    return texts.transcript(c.turns(s, d))


@query
def router_prompts(s, d):
    return texts.router_prompts(c.turns(s, d))


@query
def slot_state(s, d):
    return texts.slot_state(c.service_turns(s, d))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return texts.label_set(c.utterance_groups(s, d))


@query
def label_set(s, d):
    rows = _labels(s, d)
    return rows.withColumns({n: F.array_join(n, "|") for n in ("must_contain", "must_not_contain")})


@query
def label_summary(s, d):
    return texts.label_summary(_labels(s, d))


# --- retrieval --------------------------------------------------------------------


def _index(s: SparkSession, d: str) -> index.PassageIndex:
    return index.index_of(s, f"{d}/documents.parquet", c.passages(s, d))


@query
def bm25_search(s, d):
    return retrieval.bm25_search(_index(s, d), c.search_queries(s, d)).withColumn("rank", F.col("rank").cast("long"))


@query
def hybrid_search(s, d):
    rows = retrieval.hybrid_search(_index(s, d), c.search_queries(s, d))
    return rows.withColumns({n: F.col(n).cast("long") for n in ("rank", "fused_rank")})


@query
def passage_context(s, d):
    return retrieval.passage_context(_index(s, d), c.passages(s, d), c.search_queries(s, d))


@query
def retrieval_quality(s, d):
    return retrieval.retrieval_quality(_index(s, d), c.passages(s, d), c.search_queries(s, d))


@query
def relevance_pairs(s, d):
    return retrieval.planted_pairs(c.passages(s, d), c.search_queries(s, d))


@query
def vector_search(s, d):
    table = c.table(s, d, "embeddings")
    means = retrieval.centroids(table).withColumnRenamed("label", "query_id")
    found = vectors.vector_search(vectors.index_of(s, f"{d}/embeddings.parquet"), table, means)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query
def grounding_check(s, d):
    return retrieval.grounding_check(c.turns(s, d))


# --- live voice -------------------------------------------------------------------


@query
def live_turns(s, d):
    return live.assemble_turns(c.live_fragments(s, d))


@query
def live_session_kpis(s, d):
    return live.live_session_kpis(c.live_fragments(s, d))


@query
def live_session_close(s, d):
    return live.session_closes(c.live_fragments(s, d)).withColumn("closed_at", iso_millis("closed_at"))


@query
def live_session_summaries(s, d):
    rows = live.close_summaries(live.session_closes(c.live_fragments(s, d)))
    return rows.withColumn("created_at", iso_millis("created_at"))


@query
def live_tool_mix(s, d):
    return live.tool_mix(c.live_fragments(s, d))


# --- stores and streams, read back ------------------------------------------------


@query
def log_store(s, d):
    """The streamed day log per day and kind, and the number of lines set aside."""
    sent = F.pmod("latency_ms", F.lit(8))
    log, aside = backfill.log_backfill(c.trace_events(s, d), twice=sent == 0, broken=sent == 1)
    chars = sum(F.coalesce(F.length(n), F.lit(0)) for n in ("input_text", "output_text", "metadata"))
    days = log.groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type").agg(
        F.count("*").alias("events"),
        F.count_distinct("trace_id").alias("traces"),
        F.sum("latency_ms").alias("latency_ms"),
        F.count_if("pii_redacted").alias("redacted"),
        F.sum(chars).cast("long").alias("chars"),
    )
    lines = aside.agg(F.lit("(set aside)").alias("event_type"), F.count("*").alias("events"))
    return days.unionByName(lines, allowMissingColumns=True)


@query
def summary_store(s, d):
    return backfill.summary_backfill(c.summary_log(s, d)).withColumn("created_at", iso_millis("created_at"))


@query
def outcome_stream(s, d):
    return backfill.outcome_backfill(c.conversations(s, d))


@query
def evaluation_stream(s, d):
    rows = backfill.evaluation_backfill(c.conversations(s, d), c.trace_events(s, d))
    return rows.withColumn("created_at", iso_millis("created_at"))


@query
def live_turn_stream(s, d):
    """Turns and closes as the keyed stream writes them; tool rows have a job of their own."""
    rows = backfill.live_backfill(c.live_fragments(s, d)).where("event_type <> 'live_tool_call'")
    close = F.col("event_type") == "live_session_close"
    return rows.select(
        "trace_id",
        F.when(~close, F.col("segment")).alias("segment"),
        "turn",
        "event_type",
        "text",
        "pii_redacted",
        "preview",
        "duration_ms",
        "outcome",
        iso_millis("closed_at").alias("closed_at"),
    )


@query
def run_store(s, d):
    """Appended runs, some of them twice as after a lost reply, read back as the list."""
    path = backfill.new_folder(s, "eval-runs")
    rows = _runs(s, d)
    sinks.append_runs(rows, path)
    sinks.append_runs(rows.where(F.col("run_id").endswith("5")), path)
    return runs.newest_first(s.read.schema(EVAL_RUNS).parquet(path)).drop("created_at")


@query
def latest_results(s, d):
    """The stored results of the greatest run; no other run is opened."""
    root = backfill.new_folder(s, "runs")
    sinks.write_run(_golden(s, d), {"git_sha": "unknown"}, root)
    rows = readers.read_latest_results(s, f"{root}/results")
    return rows.select(
        "run_id", "query_id", "journey", "utterance", "response_text", "derived_outcome", "intent_correct", "hit", "task_success"
    )


@query
def reload_store(s, d):
    """Row counts after a load that held customers twice and a reload of two tables."""
    root = backfill.new_folder(s, "warehouse")
    people, talks = c.customers(s, d), c.conversations(s, d)
    frames = {"conversations": talks, "conversation_traces": c.trace_events(s, d), "customers_context": people}
    sinks.reload_tables({**frames, "eval_runs": _runs(s, d), "customers_context": people.unionAll(people)}, root)
    sinks.reload_tables({"customers_context": people, "conversations": talks}, root)
    return traces.load_counts({n: readers.read_table(s, root, n) for n in (*frames, "eval_runs")})


@query
def label_store(s, d):
    path = backfill.new_folder(s, "labels")
    sinks.write_label_set(_labels(s, d), path)
    rows = readers.read_label_set(s, path)
    return rows.withColumns({n: F.array_join(n, "|") for n in ("must_contain", "must_not_contain")})


@query
def bulk_load(s, d):
    """Customers as JSON lines, loaded under their schema and listed."""
    root = backfill.new_folder(s, "bulk")
    c.customers(s, d).write.json(f"{root}/lines")
    sinks.load_ndjson(s, f"{root}/lines", CUSTOMERS_CONTEXT, f"{root}/table")
    return customers.customer_list(s.read.schema(CUSTOMERS_CONTEXT).parquet(f"{root}/table"))
