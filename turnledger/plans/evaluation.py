"""Golden and production evaluation: per-query results and run rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.scoring import (
    any_hit,
    derived_outcome,
    normal_outcome,
    payload_cost,
    ratio,
    task_score,
)
from turnledger.functions.text import contains_all, contains_none, iso_millis, not_blank
from turnledger.operators.ranking import at_rank, nearest_rank, with_ranks
from turnledger.operators.sampling import hash_order, sample_n, sample_per_stratum
from turnledger.plans.judging import recorded_judge, rule_judge
from turnledger.plans.traces import parse_payload
from turnledger.schemas import SPECIALIST_JOURNEYS
from turnledger.session import stored

PERCENTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}


# --- per-query results -------------------------------------------------------


def trace_signals(events: DataFrame) -> DataFrame:
    """Cost and retrieval hit per trace in one pass over the log."""
    rows = parse_payload(events.select("trace_id", "event_type", "metadata"), "cost_usd", "passages")
    retrieval = F.col("event_type") == "retrieval"
    return rows.groupBy("trace_id").agg(
        F.sum(payload_cost(F.col("p.cost_usd"))).alias("trace_cost"),
        F.max(F.when(retrieval, any_hit(F.col("p.passages")))).alias("hit"),
    )


def golden_results(queries: DataFrame, responses: DataFrame, events: DataFrame, judged: DataFrame) -> DataFrame:
    """One scored row per labelled query.

    All four inputs meet on ``trace_id``, so each is shuffled once. A query without a
    response takes the pipeline-error path; its cost and hit count as not measured.
    """
    answered = queries.join(responses.withColumn("__answered", F.lit(True)), "trace_id", "left")
    missing = F.col("__answered").isNull()
    rows = answered.select(
        *queries.columns,
        missing.alias("__missing"),
        F.coalesce("response_text", F.lit("")).alias("response_text"),
        F.coalesce("response_intent", F.lit("ambiguous")).alias("response_intent"),
        F.coalesce("response_confidence", F.lit(0.0)).alias("response_confidence"),
        F.coalesce("response_grounded", F.lit(False)).alias("response_grounded"),
        F.coalesce("response_escalate", F.lit(True)).alias("response_escalate"),
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
    )
    rows = recorded_judge(rows, judged).join(trace_signals(events), "trace_id", "left")
    outcome = derived_outcome(F.col("response_text"), F.col("response_escalate"))
    trace_cost = F.when(F.col("__missing"), F.lit(0)).otherwise(F.coalesce("trace_cost", F.lit(0)))
    cost = (trace_cost.cast("decimal(18,6)") + F.col("judge_cost_micro") / F.lit(1_000_000).cast("decimal(18,0)")).cast(
        "decimal(18,6)"
    )
    return rows.select(
        "run_id",
        "query_id",
        "journey",
        "utterance",
        "expected_intent",
        "expected_outcome",
        "response_text",
        "response_intent",
        "response_confidence",
        "response_grounded",
        "response_escalate",
        outcome.alias("derived_outcome"),
        "latency_ms",
        cost.alias("cost_usd"),
        (F.col("response_intent") == F.col("expected_intent")).alias("intent_correct"),
        F.when(~F.col("__missing"), F.col("hit")).alias("hit"),
        F.col("response_grounded").alias("grounded"),
        "task_success",
        "tone_appropriate",
        "hallucinated",
        (outcome == normal_outcome(F.col("expected_outcome"))).alias("outcome_correct"),
        contains_all("response_text", "must_contain").alias("must_contain_ok"),
        contains_none("response_text", "must_not_contain").alias("must_not_contain_ok"),
        F.when(F.col("__missing"), "pipeline_exception: no response").alias("error"),
    )


# --- run rows ----------------------------------------------------------------


def _success_sums() -> dict[str, Column]:
    out = {}
    for j in SPECIALIST_JOURNEYS:
        mine = F.col("journey") == j
        out[f"__n_{j}"] = F.count_if(mine)
        # halves are exact in binary, so this sum does not depend on row order
        out[f"__s_{j}"] = F.sum(F.when(mine, task_score(F.col("task_success"))).otherwise(0.0))
    return out


def _by_latency(results: DataFrame, keys: list[str]) -> DataFrame:
    """All counters of a run, kept apart by latency: one pass feeds both the sums and
    the exact percentiles, and it is tiny because it combines map-side."""
    refused = F.col("derived_outcome") == "refused"
    micros = (F.col("cost_usd").cast("decimal(18,6)") * 1_000_000).cast("long")
    counters = {
        "n": F.count("*"),
        "contained": F.count_if(F.col("derived_outcome") == "contained"),
        "refused": F.count_if(refused),
        "well_refused": F.count_if(refused & (normal_outcome(F.col("expected_outcome")) == "refused")),
        "right_intent": F.count_if(F.col("intent_correct")),
        "hit_known": F.count("hit"),
        "hits": F.count_if(F.col("hit")),
        "made_up": F.count_if(F.col("hallucinated") == "yes"),
        "cost_n": F.count_if(micros > 0),
        "cost_micro": F.sum(F.when(micros > 0, micros)),
        **_success_sums(),
    }
    return results.groupBy(*keys, "latency_ms").agg(*[c.alias(n) for n, c in counters.items()])


_SUMMED = (
    ["n", "contained", "refused", "well_refused", "right_intent", "hit_known", "hits", "made_up", "cost_n", "cost_micro"]
    + [f"__n_{j}" for j in SPECIALIST_JOURNEYS]
    + [f"__s_{j}" for j in SPECIALIST_JOURNEYS]
)


def run_rows(results: DataFrame, keys: list[str], production: bool = False) -> DataFrame:
    """Run metrics per key in one pass over the results.

    The results shrink to one row per key and millisecond before they are ordered, so
    the window sees at most as many rows as there are distinct latencies. Production runs have no labels: their label-dependent
    metrics are null, and a task success of exactly 0 is null like a missing journey.
    """
    slim = _by_latency(results, keys)
    rows = (
        with_ranks(slim, keys, "latency_ms", "n")
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in _SUMMED],
            *[at_rank("latency_ms", p).alias(name) for name, p in PERCENTILES.items()],
        )
    )

    def success(j: str) -> Column:
        value = ratio(F.col(f"__s_{j}"), F.col(f"__n_{j}"))
        return (F.nullif(value, F.lit(0.0)) if production else value).alias(f"task_success_{j}")

    def labelled(value: Column, name: str) -> Column:
        return (F.lit(None).cast("double") if production else value).alias(name)

    mean_cost = F.rint(ratio(F.col("cost_micro"), F.col("cost_n"))) / 1e6
    return rows.select(
        *keys,
        F.col("n").alias("sample_size"),
        ratio(F.col("contained"), F.col("n")).alias("containment_rate"),
        labelled(ratio(F.col("well_refused"), F.col("refused")), "refusal_precision"),
        labelled(ratio(F.col("right_intent"), F.col("n")), "intent_accuracy"),
        labelled(ratio(F.col("hits"), F.col("hit_known")), "retrieval_hit_rate"),
        ratio(F.col("made_up"), F.col("n")).alias("hallucination_rate"),
        *[success(j) for j in SPECIALIST_JOURNEYS],
        *[F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in PERCENTILES],
        mean_cost.alias("cost_per_call_usd"),
        *[F.col(f"__n_{j}").alias(f"queries_{j}") for j in SPECIALIST_JOURNEYS],
    )


def golden_run(results: DataFrame, git_sha: str, created_at: datetime) -> DataFrame:
    """Stored run rows of a labelled evaluation, with their source and size."""
    return run_rows(results, ["run_id"]).select(
        "*",
        F.lit("golden").alias("source"),
        F.lit(git_sha).alias("git_sha"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


def journey_counts(run: DataFrame) -> DataFrame:
    """The per-journey query counts of a run row as a map."""
    pairs = [F.struct(F.lit(j).alias("key"), F.col(f"queries_{j}").alias("value")) for j in SPECIALIST_JOURNEYS]
    return run.withColumn("per_journey_counts", F.map_from_entries(F.array(*pairs)))


def task_success(results: DataFrame) -> DataFrame:
    """Long form: task success and query count per run and journey."""
    return results.groupBy("run_id", "journey").agg(
        F.count("*").alias("query_count"),
        (F.sum(task_score(F.col("task_success"))) / F.count("*")).alias("task_success"),
    )


def judge_rates(results: DataFrame) -> DataFrame:
    """Judge-side shares; answers of ``unknown`` leave the denominator."""
    rated = F.col("tone_appropriate").isin("yes", "no")
    return results.groupBy("run_id").agg(
        ratio(F.count_if(F.col("tone_appropriate") == "yes"), F.count_if(rated)).alias("tone_rate"),
        ratio(F.count_if(F.col("grounded")), F.count("*")).alias("grounded_rate"),
        ratio(F.count_if(F.col("outcome_correct")), F.count("*")).alias("outcome_correct_rate"),
        ratio(F.count_if(F.col("must_contain_ok") & F.col("must_not_contain_ok")), F.count("*")).alias("content_ok_rate"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def intent_confusion(results: DataFrame) -> DataFrame:
    return results.groupBy("expected_intent", "response_intent").agg(F.count("*").alias("queries"))


def latency_percentiles(df: DataFrame, keys: list[str], latency: str) -> DataFrame:
    hist = df.where(F.col(latency) > 0).groupBy(*keys, latency).agg(F.count("*").alias("n"))
    ranks = nearest_rank(hist, keys, latency, "n", PERCENTILES)
    sizes = hist.groupBy(*keys).agg(F.sum("n").alias("measured"))
    return sizes.join(ranks, keys)


# --- production batches ------------------------------------------------------


def high_water_mark(runs: DataFrame, modality: str, now: datetime, since_hours: int) -> Column:
    """Scalar subquery: the newest production run that covered the modality.

    A run over ``all`` covers either channel, but only a run over ``all`` covers
    ``all``. Without such a run the window of ``since_hours`` before ``now`` counts.
    """
    return high_water_marks(runs, [modality], now, since_hours)[modality]


def high_water_marks(runs: DataFrame, modalities: Sequence[str], now: datetime, since_hours: int) -> Column:
    """The marks of several modalities as one scalar struct: the runs are read once."""
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(since_hours))

    def newest(modality: str) -> Column:
        covering = [modality] if modality == "all" else [modality, "all"]
        covers = (F.col("source") == "production") & F.col("sample_modality").isin(covering)
        return F.coalesce(F.max(F.when(covers, F.col("created_at"))), start).alias(modality)

    return runs.agg(F.struct(*[newest(m) for m in modalities])).scalar()


def _is_new(mark: Column, modality: str) -> Column:
    new = F.col("created_at") > mark
    return new if modality == "all" else new & (F.col("modality") == modality)


def batch_preview(
    conversations: DataFrame, runs: DataFrame, modalities: str | Sequence[str], now: datetime, since_hours: int = 168
) -> DataFrame:
    """How many conversations the next batch of each modality would choose from, in one
    pass over the conversations."""
    modalities = [modalities] if isinstance(modalities, str) else list(modalities)
    marks = high_water_marks(runs, modalities, now, since_hours)
    rows = [
        F.struct(
            F.lit(m).alias("modality"),
            iso_millis(marks[m]).alias("since_at"),
            F.count_if(_is_new(marks[m], m)).alias("new_count"),
        ).alias(m)
        for m in modalities
    ]
    return conversations.agg(*rows).select(F.inline(F.array(*modalities)))


USER_KINDS = ("user_message", "live_user_transcript")
AGENT_KINDS = ("agent_response", "live_assistant_text")


def reconstruct(events: DataFrame, live: bool = True) -> DataFrame:
    """First utterance, final reply, last routing confidence and verdict per trace.

    One conditional aggregation instead of four scans and joins; every aggregate
    combines map-side. ``live`` also reads the live-voice kinds. Texts make Spark sort the
    rows of a task before they combine, so a row brings only the fields its kind is read for.
    """
    user = USER_KINDS if live else USER_KINDS[:1]
    agent = AGENT_KINDS if live else AGENT_KINDS[:1]
    meta = F.col("metadata")

    def of(*kinds: str) -> Column:
        return F.col("event_type").isin(*kinds)

    rows = events.where(of(*user, *agent, "intent_routing", "grounding_verification")).select(
        "trace_id",
        "event_type",
        F.struct("timestamp", "event_id").alias("at"),
        F.when(of(*user), F.col("input_text")).alias("heard"),
        F.when(of(*agent), F.col("output_text")).alias("said"),
        F.when(of("intent_routing"), F.get_json_object(meta, "$.confidence").try_cast("double")).alias("confidence"),
        F.when(
            of("grounding_verification"),
            F.struct(
                F.get_json_object(meta, "$.verdict").alias("verdict"),
                F.get_json_object(meta, "$.score").try_cast("double").alias("score"),
            ),
        ).alias("check"),
    )

    def when(*kinds: str) -> Column:
        return F.when(of(*kinds), F.col("at"))

    return rows.groupBy("trace_id").agg(
        F.min_by("heard", when(*user)).alias("utterance"),
        F.max_by("said", when(*agent)).alias("response_text"),
        F.max_by("confidence", when("intent_routing")).alias("router_confidence"),
        F.max_by("check", when("grounding_verification")).alias("check"),
    )


def production_sample(
    conversations: DataFrame,
    events: DataFrame,
    runs: DataFrame,
    modality: str,
    now: datetime,
    sample_size: int = 10,
    since_hours: int = 24,
    seed: str = "0",
    sample_first: bool = False,
    log_from: datetime | None = None,
) -> DataFrame:
    """A reproducible sample of conversations no earlier batch has covered.

    ``conversations`` has one row per trace; a log with a row per turn goes through
    ``collapse_summaries`` first. Only the log of new conversations is grouped.

    By default blank conversations are left out before the sample is drawn and live
    voice counts; ``sample_first`` draws first, drops blanks afterwards and reads
    the chat kinds only. How the sample meets the log scan is left to adaptive
    execution, which sees its real size. ``log_from`` prunes the log where the caller
    knows that no new conversation started earlier.
    """
    mark = high_water_mark(runs, modality, now, since_hours)
    fresh = conversations.where(_is_new(mark, modality))
    if log_from is not None:
        events = events.where(F.col("timestamp") >= F.lit(log_from))
    if not sample_first:
        return first_heard(fresh, events, sample_size, seed)
    drawn = sample_n(fresh, "trace_id", sample_size, seed)
    log = events.join(drawn.select("trace_id"), "trace_id", "left_semi")
    return with_turns(drawn, reconstruct(log, live=False))


def first_heard(fresh: DataFrame, events: DataFrame, n: int, seed: str = "0", growth: int = 4) -> DataFrame:
    """The first ``n`` conversations in hash order that are not blank, with their turns.

    Conversations are taken in ranges of the hash order. Only those of a range meet the log,
    as a small side, and only their rows are grouped; their rebuilt turn tells which are
    blank. The sample is complete when ``n`` were heard, since every later hash is larger,
    or when the conversations have run out; until then the next range is larger by
    ``growth``.
    """
    place = hash_order("trace_id", seed)
    ranked = fresh.withColumn("__place", place)
    size, heard, parts, last = 2 * n + 8, 0, [], None
    while True:
        later = ranked if last is None else ranked.where(F.struct("__place", "trace_id") > last)
        drawn = stored(later.orderBy("__place", "trace_id").limit(size), "drawn")
        chosen = drawn.drop("__place")
        log = events.join(chosen.select("trace_id"), "trace_id", "left_semi")
        parts.append(stored(with_turns(chosen, reconstruct(log)), "heard"))
        heard += parts[-1].count()
        end = drawn.agg(F.count("*").alias("rows"), F.max(F.struct("__place", "trace_id")).alias("last")).first()
        if heard >= n or end["rows"] < size:
            break
        last = F.struct(F.lit(end["last"]["__place"]).alias("__place"), F.lit(end["last"]["trace_id"]).alias("trace_id"))
        size *= growth
    return sample_n(reduce(DataFrame.unionByName, parts), "trace_id", n, seed)


def with_turns(conversations: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Conversations with their rebuilt turn, as the judge reads them; blank ones are left out."""
    return (
        conversations.join(rebuilt, "trace_id", "left")
        .where(not_blank("utterance"))
        .select(
            "trace_id",
            "modality",
            "journey",
            "outcome",
            "utterance",
            F.coalesce("response_text", F.lit("")).alias("response_text"),
            F.coalesce("router_confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce(F.col("check.verdict") == "pass", F.lit(False)).alias("grounded"),
            (F.col("outcome") == "escalated").alias("escalate"),
            F.col("latency_p50_ms").alias("latency_ms"),
            "cost_micro",
            "created_at",
        )
    )


def stratified_sample(conversations: DataFrame, quota: int = 5, seed: str = "0") -> DataFrame:
    return sample_per_stratum(conversations, ["modality", "journey"], "trace_id", quota, seed).select(
        "modality", "journey", "sample_rank", "trace_id", "outcome"
    )


def production_results(sample: DataFrame, run_id: str) -> DataFrame:
    """Judge a sample. There is no ground truth, so every label-dependent field is null."""
    judged = rule_judge(sample.withColumn("expected_outcome", F.col("outcome")))
    unknown = F.lit(None).cast("boolean")
    return judged.select(
        F.lit(run_id).alias("run_id"),
        F.col("trace_id").alias("query_id"),
        "journey",
        "utterance",
        F.lit("(production)").alias("expected_intent"),
        "expected_outcome",
        "response_text",
        F.coalesce("journey", F.lit("ambiguous")).alias("response_intent"),
        F.col("confidence").alias("response_confidence"),
        F.col("grounded").alias("response_grounded"),
        F.col("escalate").alias("response_escalate"),
        F.col("outcome").alias("derived_outcome"),
        "latency_ms",
        ((F.col("cost_micro") + F.col("judge_cost_micro")) / F.lit(1_000_000).cast("decimal(18,0)"))
        .cast("decimal(18,6)")
        .alias("cost_usd"),
        unknown.alias("intent_correct"),
        unknown.alias("hit"),
        "grounded",
        "task_success",
        "tone_appropriate",
        "hallucinated",
        unknown.alias("outcome_correct"),
        F.lit(True).alias("must_contain_ok"),
        F.lit(True).alias("must_not_contain_ok"),
        F.lit(None).cast("string").alias("error"),
    )


def production_run(results: DataFrame, modality: str) -> DataFrame:
    """The run row; an empty sample gives no row, so nothing is written."""
    return run_rows(results, ["run_id"], production=True).select(
        "*", F.lit("production").alias("source"), F.lit(modality).alias("sample_modality")
    )
