"""Edge cases of the jobs, and invariance under partitioning."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.plans import (
    clusters,
    customers,
    evaluation,
    index,
    judging,
    policy,
    readout,
    retrieval,
    runs,
    texts,
    traces,
)
from turnledger.operators.sampling import hash_order
from turnledger.schemas import CONVERSATIONS, EVAL_RUNS, LABELLED_SET, QUERY_RESULTS, TRACE_EVENTS
from turnledger.sources import canonical as c
from turnledger.sources import listing, readers, sinks

NOW = datetime(2024, 1, 31)


def _key(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def _event(trace, n, kind, source=None, reply=None, meta="{}", at=0):
    return (f"{trace}_{n}", trace, kind, source, reply, meta, 5, False, datetime(2024, 1, 30, 12) + timedelta(seconds=at))


def _conversation(trace, modality="chat", outcome="contained", day=30, turns=1):
    return (trace, modality, None, None, "product_qa", outcome, turns, 100, 0.001, datetime(2024, 1, day, 12))


def _conversations(spark, rows):
    return spark.createDataFrame(rows, CONVERSATIONS).withColumn("cost_micro", (F.col("cost_usd") * 1e6).cast("long"))


def _run(run_id, modality, day, source="production"):
    return (run_id, "sha", datetime(2024, 1, day), source, 5, modality) + (None,) * 3 + (0.5,) + (None,) * 7


def test_summaries_collapse_to_one_row_per_trace(spark):
    t0 = datetime(2024, 1, 1)
    rows = [
        ("trc_1", "chat", None, None, "product_qa", "in_progress", 1, 10, 5, t0),
        ("trc_1", "chat", "7", "gold", "product_qa", "escalated", 1, 30, 6, t0 + timedelta(minutes=1)),
    ]
    log = spark.createDataFrame(
        rows,
        "trace_id string, modality string, customer_id string, tier string, journey string, outcome string, "
        "turns long, latency_p50_ms long, cost_micro long, created_at timestamp",
    )
    row = traces.collapse_summaries(log).first()
    assert (row["outcome"], row["turns"], row["cost_micro"], row["latency_p50_ms"], row["created_at"]) == ("escalated", 2, 11, 30, t0)


def test_mark_rules(spark):
    table = spark.createDataFrame([_run("a", "voice", 20), _run("b", "all", 10), _run("g", "all", 29, "golden")], EVAL_RUNS)
    conv = _conversations(spark, [_conversation("trc_1", "voice", day=25), _conversation("trc_2", "voice", day=15), _conversation("trc_3", day=15)])

    def preview(modality, table=table):
        row = evaluation.batch_preview(conv, table, modality, NOW, 168).first()
        return row["since_at"], row["new_count"]

    assert preview("voice") == ("2024-01-20T00:00:00.000Z", 1)
    assert preview("chat") == ("2024-01-10T00:00:00.000Z", 1)
    assert preview("all") == ("2024-01-10T00:00:00.000Z", 3)
    only_voice = table.where("run_id = 'a'")
    assert preview("all", only_voice) == ("2024-01-24T00:00:00.000Z", 1)  # a voice run does not bound "all"


def test_cutoff_is_strict(spark):
    table = spark.createDataFrame([_run("a", "all", 30)], EVAL_RUNS)
    conv = _conversations(spark, [("trc_1", "chat", None, None, "product_qa", "contained", 1, 1, 0.0, datetime(2024, 1, 30))])
    assert evaluation.batch_preview(conv, table, "all", NOW).first()["new_count"] == 0


def test_sample_reads_live_turns_and_skips_blanks_first(spark):
    conv = _conversations(spark, [_conversation("trc_a", "voice"), _conversation("trc_b", "voice"), _conversation("trc_c", "voice")])
    events = spark.createDataFrame(
        [
            _event("trc_a", 1, "live_user_transcript", source="hi"),
            _event("trc_a", 2, "live_assistant_text", reply="one", at=1),
            _event("trc_a", 3, "live_assistant_text", reply="two", at=2),
            _event("trc_b", 1, "user_message", source="  "),
            _event("trc_c", 1, "user_message", source="first"),
            _event("trc_c", 2, "user_message", source="second", at=1),
        ],
        TRACE_EVENTS,
    )
    empty = spark.createDataFrame([], EVAL_RUNS)
    rows = evaluation.production_sample(conv, events, empty, "voice", NOW, 10, 24).collect()
    got = {r["trace_id"]: (r["utterance"], r["response_text"]) for r in rows}
    assert got == {"trc_a": ("hi", "two"), "trc_c": ("first", "")}
    first = evaluation.production_sample(conv, events, empty, "voice", NOW, 10, 24, sample_first=True).collect()
    assert {r["trace_id"] for r in first} == {"trc_c"}


def test_empty_sample_writes_no_run(spark):
    conv = _conversations(spark, [])
    events = spark.createDataFrame([], TRACE_EVENTS)
    sample = evaluation.production_sample(conv, events, spark.createDataFrame([], EVAL_RUNS), "all", NOW)
    assert evaluation.production_run(evaluation.production_results(sample, "r"), "all").count() == 0


def _result(qid, **kw):
    base = dict(
        query_id=qid, journey="product_qa", utterance="u", expected_intent="product_qa", expected_outcome="Contained",
        response_text="r", response_intent="product_qa", response_confidence=1.0, response_grounded=True,
        response_escalate=False, derived_outcome="contained", latency_ms=10, cost_usd=0.001, intent_correct=True, hit=True,
        grounded=True, task_success="resolved", tone_appropriate="yes", hallucinated="no", outcome_correct=True,
        must_contain_ok=True, must_not_contain_ok=True, error=None,
    )
    base.update(kw)
    return tuple(base[f] for f in QUERY_RESULTS.fieldNames())


def _results(spark, rows):
    return spark.createDataFrame(rows, QUERY_RESULTS).withColumn("run_id", F.lit("r1"))


def test_zero_denominators_and_zero_latency(spark):
    row = evaluation.run_rows(_results(spark, [_result("q", latency_ms=0, cost_usd=0.0, hit=None, journey="escalate")]), ["run_id"]).first()
    assert row["refusal_precision"] == 0.0 and row["retrieval_hit_rate"] == 0.0
    assert row["latency_p95_ms"] == 0 and row["cost_per_call_usd"] == 0.0
    assert row["task_success_product_qa"] == 0.0


def test_production_run_nulls(spark):
    rows = _results(spark, [_result("q", task_success="failed", intent_correct=None, hit=None)])
    row = evaluation.production_run(rows, "voice").first()
    assert row["task_success_product_qa"] is None and row["task_success_order_status"] is None
    assert row["intent_accuracy"] is None and row["hallucination_rate"] == 0.0


@pytest.mark.parametrize(
    "fields, cluster",
    [
        (dict(intent_correct=False, hallucinated="yes"), "wrong_intent"),
        (dict(hit=None, task_success="failed"), "retrieval_miss"),
        (dict(hit=False, hallucinated="yes"), "retrieval_miss"),
        (dict(hallucinated="yes", derived_outcome="refused"), "hallucination"),
        (dict(derived_outcome="refused", expected_outcome=" REFUSED", task_success="partial"), "refused_correctly"),
        (dict(derived_outcome="refused", outcome_correct=False), "refused_incorrectly"),
        (dict(task_success="partial"), "incomplete"),
        (dict(task_success="error"), "other"),
        (dict(), None),
        (dict(intent_correct=None, outcome_correct=None, task_success="failed"), None),
    ],
)
def test_first_cluster_wins(spark, fields, cluster):
    rows = clusters.failures(_results(spark, [_result("q", **fields)])).collect()
    assert [r["cluster"] for r in rows] == ([cluster] if cluster else [])


def test_cluster_document_and_run_files(spark, tmp_path):
    rows = [_result(f"q{i:02d}", task_success="failed") for i in range(9)] + [_result("z")]
    results = _results(spark, rows)
    doc = clusters.cluster_documents(results).first()
    assert doc["total_rows"] == 10 and doc["total_failures"] == 9
    assert [(x["name"], x["count"], len(x["examples"])) for x in doc["clusters"]] == [("other", 9, 5)]
    assert [e["query_id"] for e in doc["clusters"][0]["examples"]] == ["q00", "q01", "q02", "q03", "q04"]
    root = str(tmp_path / "runs")
    sinks.write_run(results, {"git_sha": "abc"}, root)
    sinks.write_run(results, {"git_sha": "abc"}, root)  # rewriting a run replaces it
    older = results.withColumn("run_id", F.lit("r0"))
    sinks.write_run(older, {"git_sha": "abc"}, root)
    back = readers.read_results(spark, f"{root}/results")
    assert back.count() == 20
    latest = readers.read_latest_results(spark, f"{root}/results")
    assert latest.select("run_id").distinct().collect()[0][0] == "r1" and latest.count() == 10
    summary = spark.read.json(f"{root}/summaries").where("run_id = 'r1'").first()
    assert summary["per_journey_counts"]["product_qa"] == 10


def test_run_table_append_and_reload(spark, sf_dir, tmp_path):
    table = c.eval_runs(evaluation.run_rows(c.eval_results(spark, sf_dir), ["run_id"]))
    path = str(tmp_path / "eval_runs")
    sinks.append_runs(table, path)
    sinks.append_runs(table.limit(1), path)  # a retry
    assert spark.read.schema(EVAL_RUNS).parquet(path).count() == table.count()
    sinks.append_runs(table.limit(1).withColumn("run_id", F.lit("evr_more")), path)
    assert spark.read.schema(EVAL_RUNS).parquet(path).count() == table.count() + 1
    with pytest.raises(ValueError):
        sinks.append_runs(table.drop("git_sha"), path)
    frames = {"conversations": c.conversations(spark, sf_dir), "eval_runs": table}
    first = _key(sinks.reload_tables(frames, str(tmp_path / "wh")).collect())
    assert first == _key(sinks.reload_tables(frames, str(tmp_path / "wh")).collect())
    assert ("eval_runs", str(table.count())) in first


def test_a_reload_that_fails_halfway_changes_no_table(spark, sf_dir, tmp_path):
    root = str(tmp_path / "wh")
    table = c.eval_runs(evaluation.run_rows(c.eval_results(spark, sf_dir), ["run_id"]))
    talks, people = c.conversations(spark, sf_dir), c.customers(spark, sf_dir)
    sinks.reload_tables({"conversations": talks, "customers_context": people, "eval_runs": table}, root)
    broken = people.withColumn("customer_id", F.raise_error(F.lit("halfway")).cast("string"))
    with pytest.raises(Exception, match="halfway"):
        sinks.reload_tables({"conversations": talks.limit(1), "customers_context": broken, "eval_runs": table.limit(1)}, root)
    counts = {n: readers.read_table(spark, root, n).count() for n in ("conversations", "customers_context", "eval_runs")}
    assert counts == {"conversations": talks.count(), "customers_context": people.count(), "eval_runs": table.count()}
    sinks.reload_tables({"eval_runs": table.limit(1)}, root)  # the others stay
    assert readers.read_table(spark, root, "eval_runs").count() == 1
    assert readers.read_table(spark, root, "conversations").count() == talks.count()


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path)
    empty = listing.read_manifest(spark, root)
    assert empty.version == -1
    first = listing.commit(spark, root, empty, {"a": 1})
    with pytest.raises(RuntimeError):
        listing.commit(spark, root, empty, {"a": 2})
    assert listing.read_manifest(spark, root) == first
    assert listing.read_manifest(spark, root, listing.commit(spark, root, first, {"a": 3}).version).entries == {"a": 3}


def test_the_latest_run_is_found_by_its_folder(spark, tmp_path):
    root = str(tmp_path / "runs")
    results = _results(spark, [_result("q")])
    for run in ("r1", "r10", "r2"):
        sinks.write_run(results.withColumn("run_id", F.lit(run)), {}, root)
    assert readers.read_latest_results(spark, str(tmp_path / "none")).count() == 0
    latest = readers.read_latest_results(spark, f"{root}/results")
    assert {f.split("run_id=")[1].split("/")[0] for f in latest.inputFiles()} == {"r2"}
    assert latest.first()["run_id"] == "r2"


def test_sampling_takes_ranges_of_the_hash_order(spark):
    """More blank conversations than the first ranges hold, and fewer than asked."""
    talks = _conversations(spark, [_conversation(f"trc_{i}") for i in range(120)])
    said = lambda i: "hello" if i % 12 == 0 else " "
    events = spark.createDataFrame([_event(f"trc_{i}", 1, "user_message", said(i)) for i in range(120)], TRACE_EVENTS)
    order = [r["trace_id"] for r in talks.orderBy(hash_order("trace_id", "0")).select("trace_id").collect()]
    heard = [t for t in order if int(t[4:]) % 12 == 0]
    for n in (1, 3, 10, 40):
        drawn = evaluation.first_heard(talks, events, n, growth=2)
        assert [r["trace_id"] for r in drawn.collect()] == heard[:n]


def test_label_set_round_trip(spark, sf_dir, tmp_path):
    labelled = texts.label_set(c.utterance_groups(spark, sf_dir))
    path = str(tmp_path / "labels")
    sinks.write_label_set(labelled, path)
    back = readers.read_label_set(spark, path)
    assert back.schema == LABELLED_SET or back.columns == LABELLED_SET.fieldNames()
    assert _key(back.collect()) == _key(labelled.collect())
    assert readers.read_label_set(spark, path, limit=3).count() == 3
    with pytest.raises(ValueError):
        texts.expect_sizes(labelled, {"order_status": 50})


def test_fixture_reader_fails_fast(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"run_id": "r", "sample_size": 3}]')
    bad.write_text('[{"run_id": "r", "sample_size": "many"}]')
    schema = "run_id string, sample_size long"
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    assert readers.read_fixture(spark, str(good), parsed).count() == 1
    with pytest.raises(Exception):
        readers.read_fixture(spark, str(bad), parsed).collect()
    with pytest.raises(Exception):
        readers.read_label_set(spark, str(tmp_path / "absent")).count()


def test_run_list_defaults(spark):
    rows = [("r", "s", datetime(2024, 1, 1), None, None, "fax") + (None,) * 3 + (0.5,) + (None,) * 7]
    table = spark.createDataFrame(rows, EVAL_RUNS)
    row = runs.run_list(table).first()
    assert (row["source"], row["total_queries"], row["sample_modality"]) == ("golden", 150, None)
    long = runs.metrics_long(runs.run_list(table)).collect()
    assert [r["metric_name"] for r in long] == ["containment"]


def test_failing_judge_rows_get_the_sentinel(spark):
    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["response_text"] == "boom").any():
            raise RuntimeError("model down")
        return pd.DataFrame(
            {"task_success": " Resolved", "tone_appropriate": "YES", "hallucinated": "no", "judge_cost_usd": 0.001},
            index=batch.index,
        )

    rows = spark.createDataFrame(
        [(i, "u", t, "Contained", "product_qa") for i, t in enumerate(["ok", "boom", " ", "fine"])],
        "id long, utterance string, response_text string, expected_outcome string, journey string",
    )
    got = {r["id"]: (r["task_success"], float(r["judge_cost_usd"])) for r in judging.judge_with(rows, judge).collect()}
    assert got == {0: ("resolved", 0.001), 1: ("error", 0.0), 2: ("failed", 0.0), 3: ("resolved", 0.001)}


def test_policy_cascade(spark):
    schema = (
        "trace_id string, turns long, outcome string, journey string, route struct<intent:string,confidence:double>, "
        "first_check struct<verdict:string,score:double>, second_check struct<verdict:string,score:double>, tool_error boolean"
    )
    good, bad = ("pass", 0.9), ("fail", 0.1)

    def case(name, route, one=good, two=None, tool=False, turns=1):
        return (name, turns, "contained", "product_qa", route, one, two, tool)

    rows = [
        case("router", None),
        case("low", ("product_qa", 0.59)),
        case("human", ("escalation", 0.9)),
        case("off", ("out_of_scope", 0.9)),
        case("cap", ("product_qa", 0.9), turns=13),
        case("tool", ("product_qa", 0.9), tool=True),
        case("fine", ("product_qa", 0.9)),
        case("retry", ("product_qa", 0.9), bad, good),
        case("weak", ("product_qa", 0.9), ("pass", 0.79), None),
    ]
    got = {r["trace_id"]: (r["replayed_outcome"], r["reason"]) for r in policy.decide(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "router": ("escalated", "router_error"),
        "low": ("escalated", "low_confidence"),
        "human": ("escalated", "explicit_request"),
        "off": ("refused", None),
        "cap": ("escalated", "turn_cap"),
        "tool": ("escalated", "tool_error"),
        "fine": ("contained", None),
        "retry": ("contained", None),
        "weak": ("refused", "grounding_failed"),
    }


def test_bursts_cross_slices_and_clear_on_success(spark):
    t0 = datetime(2024, 1, 1)

    def at(n, s, failed=True, service="a"):
        return (service, n, t0 + timedelta(seconds=s), failed)

    rows = [at(1, 50), at(2, 59), at(3, 61), at(4, 110), at(5, 112, False), at(6, 113), at(7, 114), at(8, 115), at(9, 500), at(1, 0, service="b")]
    df = spark.createDataFrame(rows, "service string, event_id long, timestamp timestamp, failed boolean")
    got = {(r["service"], r["event_id"]): r["failures_in_window"] for r in policy.failure_bursts(df).collect()}
    assert got == {("a", 3): 3, ("a", 4): 4, ("a", 8): 3}


def test_documents_page_long_traces(spark):
    conv = _conversations(spark, [_conversation("trc_1"), _conversation("trc_2")])
    events = spark.createDataFrame([_event("trc_1", i, "stt", at=i * 50) for i in range(5)], TRACE_EVENTS)
    rows = traces.trace_documents(conv, events, page_size=2).orderBy("trace_id", "page").collect()
    assert [(r["trace_id"], r["page"], len(r["events"]), r["event_count"]) for r in rows] == [
        ("trc_1", 0, 2, 5), ("trc_1", 1, 2, 5), ("trc_1", 2, 1, 5), ("trc_2", 0, 0, 0),
    ]
    assert rows[0]["ended_at"] == "2024-01-30T12:03:20.000Z" and rows[3]["ended_at"] == rows[3]["started_at"]
    one = traces.trace_document(conv, events, "trc_1").collect()
    assert len(one) == 1 and len(one[0]["events"]) == 5


def test_skipped_unknown_and_broken_payloads(spark):
    events = spark.createDataFrame(
        [
            _event("trc_1", 1, "stt", meta='{"skipped": true}'),
            _event("trc_1", 2, "mystery"),
            _event("trc_1", 3, "intent_routing", meta="{bad"),
            _event("trc_1", 4, "grounding_verification", meta=None),
            _event("trc_1", 5, "escalation", meta='{"reason":"tool_error"}'),
        ],
        TRACE_EVENTS,
    )
    rows = {r["event_type"]: r for r in traces.event_report(traces.typed_events(events)).collect()}
    assert set(rows) == {"router", "verification"}
    assert (rows["router"]["intent"], rows["router"]["model"], rows["router"]["below_threshold"]) == ("ambiguous", "gemini-2.0-flash", True)
    assert (rows["verification"]["verdict"], rows["verification"]["attempt"]) == ("pass", 1)
    assert traces.typed_events(events, full=True).where("event_type = 'escalation'").count() == 1
    broken = traces.quarantine(events, traces.event_rules()).collect()
    assert {tuple(r["violations"]) for r in broken} == {("event_type_enum",), ("metadata_json",)}


def indexed(passages, folder):
    index.write_index(passages, f"{folder}/index")
    return index.open_index(passages.sparkSession, f"{folder}/index")


def test_planted_pairs_equal_brute_force(spark):
    passages = spark.createDataFrame(
        [(1, "xThe quick brown fox jumps over dogsy and more"), (2, "the quick brown fox"), (3, "a fox"), (4, "The quick, brown fox jumps over dogs"), (5, None)],
        "passage_id long, content string",
    )
    queries = spark.createDataFrame(
        [
            (1, "The quick brown fox jumps over dogs"), (2, "fox"), (3, " fox"), (4, "absent words in here that never come together"),
            (5, "quick brown fox jumps over dogsy and"), (6, "he quick brown fox jumps over dog"), (7, "quick, brown fox jumps over dogs and"),
        ],
        "query_id long, query string",
    )
    brute = {
        (q["query_id"], p["passage_id"])
        for q in queries.collect()
        for p in passages.collect()
        if p["content"] and q["query"] in p["content"]
    }
    assert {tuple(r) for r in retrieval.planted_pairs(passages, queries).collect()} == brute


def test_fusion_takes_full_ranks(spark, tmp_path):
    """A passage beyond rank 20 of one list still gets its share of that list."""
    texts = [(i, "drill " * (1 + i % 7) + "part " * (i % 3) + f"w{i} " * (i % 11)) for i in range(60)]
    passages = spark.createDataFrame(texts, "passage_id long, content string")
    queries = spark.createDataFrame([(7, "drill part"), (8, "part")], "query_id long, query string")
    table = indexed(passages, tmp_path)
    scored = index.score(table, index.weighted_terms(table, queries)).collect()
    want = {}
    for q in (7, 8):
        rows = [r for r in scored if r["query_id"] == q]
        for by in ("bm25", "semantic"):
            for n, r in enumerate(sorted(rows, key=lambda r: (-r[by], r["passage_id"])), 1):
                want.setdefault((q, r["passage_id"]), []).append(n)
    got = retrieval.hybrid_search(table, queries, k=60, candidates=60).collect()
    assert {(r["query_id"], r["passage_id"]): [r["bm25_rank"], r["semantic_rank"]] for r in got} == want
    assert max(max(ranks) for ranks in want.values()) > 20
    for q in (7, 8):
        fused = {p: round(1 / (60 + a) + 1 / (60 + b), 9) for (k, p), (a, b) in want.items() if k == q}
        order = sorted(fused, key=lambda p: (-fused[p], p))
        assert [r["passage_id"] for r in sorted(got, key=lambda r: r["fused_rank"]) if r["query_id"] == q] == order


def test_rerank_hook(spark, tmp_path):
    passages = spark.createDataFrame([(1, "red drill"), (2, "blue drill drill")], "passage_id long, content string")
    queries = spark.createDataFrame([(7, "drill")], "query_id long, query string")
    head = retrieval.hybrid_search(indexed(passages, tmp_path), queries, k=2)
    rows = retrieval.rerank_with(head, passages, queries, lambda b: b["content"].str.count("drill"), 1).collect()
    assert [(r["passage_id"], r["rerank_score"]) for r in rows] == [(2, 2.0)]


def test_anonymous_and_foreign_callers(spark):
    cols = "order_key long, order_id string, customer_id string, sku string, product_name string, quantity long, status string, order_date timestamp, eta timestamp, tracking_no string"
    orders = spark.createDataFrame(
        [(4521 + i, f"#{4521 + i}", "1", "S", "drill", 1, "delivered", datetime(2024, 1, 1 + i), None, None) for i in range(4)], cols
    )
    requests = spark.createDataFrame(
        [("a", None, "where is it"), ("b", None, "order #9999"), ("c", None, "order #4521"), ("d", "1", "order 4524"), ("e", "2", "order 4524"), ("f", "1", "hm")],
        "request_id string, customer_id string, utterance string",
    )
    got = {r["request_id"]: r for r in customers.order_status_context(requests, orders).collect()}
    assert got["a"]["awaiting_slot"] and got["a"]["lookup_mode"] == "ask"
    assert "no order with that ID exists" in got["b"]["context"]
    assert got["c"]["context"].count("order_id=") == 1 and got["d"]["own_order"]
    assert "belongs to this customer" in got["e"]["context"] and got["e"]["context"].endswith("(no orders found for this customer)")
    assert [line.split(",")[0] for line in got["f"]["context"].split("\n")[1:]] == ["- order_id=#4524", "- order_id=#4523", "- order_id=#4522"]


def test_records_are_held_to_a_closed_schema(spark, tmp_path):
    schema = "order_id string NOT NULL, quantity int, note string"
    schema = T.StructType([T.StructField(f.name, f.dataType, f.name != "order_id") for f in T._parse_datatype_string(schema)])
    lines = [
        '{"order_id": "a", "quantity": 2}',
        '{"order_id": "a", "quantity": null, "note": "x"}',
        '{"quantity": 2, "zip": 1, "colour": "red"}',
        '{"order_id": "a", "quantity": "many"}',
        '[1, 2]',
        "{broken",
        "   ",
        '{"order_id": null, "a\'b": 1}',
    ]
    (tmp_path / "orders.json").write_text("\n".join(lines))
    rows = {r["line"]: list(r["violations"]) for r in readers.read_contract(spark, str(tmp_path / "orders.json"), schema).collect()}
    assert rows == {
        lines[0]: [], lines[1]: [], lines[2]: ["missing:order_id", "extra:colour", "extra:zip"], lines[3]: ["type:quantity"],
        lines[4]: ["not_an_object"], lines[5]: ["not_an_object"], lines[7]: ["missing:order_id", "extra:a'b"],
    }


def test_prompts_are_the_same_for_any_page_and_bounded_on_request(spark):
    turns = spark.createDataFrame(
        [("t", i, "customer" if i % 2 == 0 else "agent", None if i == 3 else f"x{i}") for i in range(9)] + [("u", 4, "customer", "y")],
        "trace_id string, turn long, role string, text string",
    )
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(texts.router_prompts(turns))
    assert whole == key(texts.router_prompts(turns, page_turns=2)) == key(texts.router_prompts(turns, page_turns=1))
    assert whole == key(texts.router_prompts(turns, max_turns=100))
    short = {(r["trace_id"], r["turn"]): r["prompt"] for r in texts.router_prompts(turns, "{{HISTORY}}>{{UTTERANCE}}", max_turns=2).collect()}
    assert short["t", 8] == "customer: x6\nagent: x7>x8" and short["t", 0] == "(no prior turns)>x0" == short["u", 4].replace("y", "x0")


def test_every_customer_turn_is_prompted(spark):
    turns = spark.createDataFrame(
        [("t", i, "customer" if i % 2 == 0 else "agent", f"x{i}") for i in range(6)], "trace_id string, turn long, role string, text string"
    )
    rows = {r["turn"]: r["prompt"] for r in texts.router_prompts(turns, "{{HISTORY}}>{{UTTERANCE}}").collect()}
    assert rows[0] == "(no prior turns)>x0" and rows[2] == "customer: x0\nagent: x1>x2"
    assert rows[4] == "customer: x0\nagent: x1\ncustomer: x2\nagent: x3>x4"
    long = spark.createDataFrame([("t", i, "customer", f"x{i}") for i in range(30)], turns.schema)
    assert texts.router_prompts(long).where("prompt is not null").count() == 30
    pages = texts.transcript(turns, page_turns=4).collect()
    assert sorted((r["page"], r["turns"]) for r in pages) == [(0, 4), (1, 2)]


@pytest.mark.parametrize("name", ["golden_eval", "conversation_rollup", "failure_clusters", "trace_cost", "slot_state", "live_turns"])
def test_results_do_not_depend_on_partitioning(spark, sf_dir, name):
    from turnledger.catalog import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = _key(QUERIES[name](spark, sf_dir).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        other = _key(QUERIES[name](spark, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert one == other


def test_classifier_and_verifier_hooks(spark):
    def classify(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["text"] == "boom").any():
            raise RuntimeError("down")
        return pd.DataFrame({"intent": batch["text"], "confidence": [0.9] * len(batch)})

    turns = spark.createDataFrame([("a", "order_status"), ("b", "small_talk"), ("c", "boom")], "trace_id string, text string")
    got = {r["trace_id"]: tuple(r["route"]) for r in judging.classify_with(turns, classify).collect()}
    assert got == {"a": ("order_status", 0.9), "b": ("out_of_scope", 0.4), "c": ("out_of_scope", 0.0)}

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grounded": [a in b for a, b in zip(batch["claim"], batch["context"])]})

    claims = spark.createDataFrame(
        [("t", 1, "x", "x y"), ("t", 1, "z", "x y"), ("t", 2, "y", "x y"), ("t", 3, None, "x y")],
        "trace_id string, turn long, claim string, context string",
    )
    rows = {r["turn"]: (r["claims"], r["score"], r["verdict"]) for r in judging.verify_with(claims, scorer).collect()}
    assert rows == {1: (2, 0.5, "fail"), 2: (1, 1.0, "pass"), 3: (1, 0.0, "fail")}


def test_golden_run_row_and_policy_hash(spark, tmp_path):
    from turnledger.schemas import Policy

    row = evaluation.golden_run(_results(spark, [_result("q")]), "abc", NOW)
    sinks.append_runs(row, str(tmp_path / "r"))
    stored = spark.read.schema(EVAL_RUNS).parquet(str(tmp_path / "r")).first()
    assert (stored["source"], stored["sample_size"], stored["containment_rate"]) == ("golden", 1, 1.0)
    assert sinks.policy_hash(Policy()) == sinks.policy_hash(Policy()) != sinks.policy_hash(Policy(router_threshold=0.7))


def test_list_filters(spark):
    conv = _conversations(spark, [_conversation("trc_1", "voice", day=3), _conversation("trc_2", "chat", day=9), _conversation("trc_3", "voice", day=12)])
    names = lambda **kw: [r["trace_id"] for r in traces.trace_list(conv, **kw).collect()]
    assert names() == ["trc_3", "trc_2", "trc_1"]
    assert names(modality="voice", limit=1) == ["trc_3"]
    assert names(since=datetime(2024, 1, 9)) == ["trc_3", "trc_2"]
    assert len(names(limit=0)) == 3  # no limit means the default


def test_readout_scope_and_drill(spark):
    conv = _conversations(spark, [_conversation("trc_1", "voice", "escalated"), _conversation("trc_2", "chat", "escalated"), _conversation("trc_3", "chat", "refused")])
    tool = '{"reason":"tool_error"}'
    hit = '{"passages":[{"rerank_score":0.9}]}'
    events = spark.createDataFrame(
        [_event("trc_1", 1, "escalation", meta=tool), _event("trc_2", 1, "escalation", meta=tool), _event("trc_3", 1, "retrieval", meta=hit)], TRACE_EVENTS
    )
    rows = {r["failure_type"]: (r["modality"], r["count"]) for r in clusters.cluster_readout(conv, events).collect()}
    assert rows == {"tool_error": ("both", 2), "over_eager_refusal": ("chat", 1)}
    voice = clusters.cluster_readout(conv, events, scope="voice")
    assert [r["failure_type"] for r in voice.collect()] == ["tool_error"]
    assert {r["trace_id"] for r in clusters.cluster_drill(voice, conv).collect()} == {"trc_1", "trc_2"}


def test_ndjson_load_appends_and_fails_fast(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("run_id string, sample_size long")
    good, bad, out = tmp_path / "good.json", tmp_path / "bad.json", str(tmp_path / "out")
    good.write_text('{"run_id":"r1","sample_size":3}\n{"run_id":"r2"}\n')
    bad.write_text('{"run_id":"r3","sample_size":"many"}\n')
    for _ in range(2):
        sinks.load_ndjson(spark, str(good), schema, out)
    assert _key(spark.read.parquet(out).collect()) == _key([("r1", 3), ("r1", 3), ("r2", None), ("r2", None)])
    with pytest.raises(Exception):
        sinks.load_ndjson(spark, str(bad), schema, out)


def test_empty_channel_takes_the_latest_run(spark):
    conv = _conversations(spark, [_conversation("trc_1", "voice"), _conversation("trc_2", "voice", "refused")])
    table = spark.createDataFrame([_run("a", "all", 1), _run("b", "all", 2)], EVAL_RUNS).withColumn(
        "containment_rate", F.when(F.col("run_id") == "b", 0.25).otherwise(0.75)
    )
    rows = {r["channel"]: (r["n"], r["containment"]) for r in readout.business_readout(conv, table).collect()}
    assert rows == {"voice": (2, 0.5), "chat": (0, 0.25), "all": (2, 0.5)}


def test_customer_words_are_no_evidence(spark):
    turns = spark.createDataFrame(
        [
            ("trc_1", 0, "customer", "The warranty covers water damage."),
            ("trc_1", 1, "agent", "The warranty covers water damage."),
            ("trc_2", 0, "context", "Our warranty covers water damage for a year."),
            ("trc_2", 1, "agent", "The warranty covers water damage."),
        ],
        "trace_id string, turn long, role string, text string",
    )
    rows = {r["trace_id"]: r["verdict"] for r in retrieval.grounding_check(turns).collect()}
    assert rows == {"trc_1": "fail", "trc_2": "pass"}
    heard = retrieval.grounding_check(turns, evidence=("customer", "context"))
    assert {r["verdict"] for r in heard.collect()} == {"pass"}


def test_null_event_kind_breaks_its_rule(spark):
    events = spark.createDataFrame([("trc_1_1", "trc_1", None, None, None, "{}", 5, False, NOW), ("trc_1_2", "trc_1", "stt", None, None, "{}", 5, False, NOW)],
        "event_id string, trace_id string, event_type string, input_text string, output_text string, metadata string, latency_ms long, pii_redacted boolean, timestamp timestamp")
    assert [(r["event_id"], r["violations"]) for r in traces.quarantined_events(events).collect()] == [("trc_1_1", "event_type_enum")]


def test_collapsed_summaries_are_sampled_once(spark):
    log = _conversations(spark, [_conversation("trc_1"), _conversation("trc_1"), _conversation("trc_2")])
    events = spark.createDataFrame([_event(t, 1, "user_message", "hi") for t in ("trc_1", "trc_2")], TRACE_EVENTS)
    table = spark.createDataFrame([_run("a", "all", 1)], EVAL_RUNS)
    drawn = evaluation.production_sample(traces.collapse_summaries(log), events, table, "all", NOW)
    assert sorted(r["trace_id"] for r in drawn.collect()) == ["trc_1", "trc_2"]


def test_refusal_spikes_stand_out_of_their_channel(spark):
    rows = [_conversation(f"trc_{i}", day=1 + i % 9) for i in range(60)]
    rows += [_conversation(f"trc_r{i}", outcome="refused", day=12) for i in range(6)]
    found = readout.refusal_spikes(_conversations(spark, rows)).collect()
    assert [(r["window_start"], r["refused"], r["refusal_rate"]) for r in found] == [("2024-01-12 12:00:00", 6, 1.0)]


def test_customers_are_listed_by_id_and_found(spark, sf_dir):
    people = c.customers(spark, sf_dir)
    ids = [r["customer_id"] for r in customers.customer_list(people).collect()]
    assert ids == sorted(ids)
    assert [r["customer_id"] for r in customers.customer_by_id(people, ids[3]).collect()] == [ids[3]]
