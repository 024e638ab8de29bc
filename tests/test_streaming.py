"""Streams must agree with the batch jobs over the same rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnledger.plans import evaluation, live, readout, traces
from turnledger.schemas import EVAL_RUNS
from turnledger.sources import canonical as c
from turnledger.sources import listing
from turnledger.sources.readers import bad_rows, good_rows, read_trace_log
from turnledger.sources.sinks import write_log
from turnledger.streaming import evaluate, ingest
from turnledger.streaming.live import live_turn_stream, summary_of_closes, verify_after_turn


def _files(df, path, parts, order):
    """Write the rows as ``parts`` parquet files, one per later micro-batch."""
    rows = [r for r in df.orderBy(order).collect()]
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_drops_repeats_and_sets_bad_rows_aside(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    base = datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    lines = [
        '{"event_id":"e%d","trace_id":"trc_1","event_type":"stt","latency_ms":1,"pii_redacted":false,"timestamp":"%s"}'
        % (i % 5, (base + timedelta(seconds=i % 5)).isoformat())
        for i in range(10)
    ]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines[:6] + ["{broken"]))
    (tmp_path / "in" / "b.json").write_text("\n".join(lines[6:]))
    log = read_trace_log(spark, source, stream=True)
    ingest.append_log(ingest.deduplicated(good_rows(log)), out, ckpt).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == 5 and stored.select("event_id").distinct().count() == 5
    batch = read_trace_log(spark, source).cache()
    assert bad_rows(batch).count() == 1


def test_summary_upsert_equals_batch(spark, sf_dir, tmp_path):
    log = c.summary_log(spark, sf_dir)
    _files(log, str(tmp_path / "in"), 3, "created_at")
    stream = _stream(spark, log, str(tmp_path / "in"))
    ingest.upsert_summaries(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    merged = ingest.current_summaries(spark, str(tmp_path / "out"))
    expected = traces.collapse_summaries(log)
    assert merged.exceptAll(expected).count() == 0 and expected.exceptAll(merged).count() == 0


def test_summary_levels_bound_reads_and_replays_change_nothing(spark, sf_dir, tmp_path):
    log = c.summary_log(spark, sf_dir).where("hash(trace_id) % 4 = 0")
    root = str(tmp_path / "store")
    store = ingest.SummaryStore(spark, root, fan_in=3)
    assert store.read().count() == 0
    parts = [log.where(F.abs(F.hash("trace_id", "created_at")) % 14 == i) for i in range(14)]
    for i, part in enumerate(parts):
        store.add(ingest.summary_partials(part), i)
        live = store.segments()
        assert all(sum(s["level"] == n for s in live) < 3 for n in range(4))  # few per level
        assert sorted(b for s in live for b in range(s["first"], s["last"] + 1)) == list(range(i + 1))
    assert len(store.segments()) <= 5 and max(s["level"] for s in store.segments()) == 2
    read = store.read()
    assert len(read.inputFiles()) < len(parts) * 2  # files of live segments only
    expected = traces.collapse_summaries(log)
    assert read.exceptAll(expected).count() == 0 and expected.exceptAll(read).count() == 0
    before = store.segments()
    for i in (0, 7, 13):
        store.add(ingest.summary_partials(parts[i]), i)
    assert store.segments() == before
    # what no recent manifest names is gone
    kept = {s["name"] for s in before}
    assert len(listing.names(spark, f"{root}/segments")) <= len(kept) + 3
    # a batch that fails before its commit leaves the store as it was
    broken = ingest.summary_partials(parts[0]).withColumn("turns", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        store.add(broken, 99)
    assert store.segments() == before and store.read().exceptAll(expected).count() == 0


def test_live_turns_stream_equals_batch(spark, sf_dir, tmp_path):
    fragments = c.live_fragments(spark, sf_dir)
    _files(fragments, str(tmp_path / "in"), 4, "seq")  # every session spans several batches
    stream = live_turn_stream(_stream(spark, fragments, str(tmp_path / "in")), lateness="30 days")
    query = (
        stream.writeStream.format("memory")
        .queryName("live_out")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.table("live_out").where(~F.col("event_type").isin("live_session_close", "live_tool_call", "live_late_fragment"))
    inside = live.bounded_sessions(fragments).where("in_session").drop("in_session")
    expected = live.assemble_turns(inside)
    names = ["trace_id", "segment", "turn", "event_type", "text", "pii_redacted", "preview"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got.select(names).collect())) == sorted(map(key, expected.select(names).collect()))


def test_session_ceiling_closes_the_session(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "trace_id string, seq long, timestamp timestamp, kind string, text string"
    first = [("live_1", 1, start, "user_fragment", "call 555-123-4567 "), ("live_1", 3, start + timedelta(seconds=2), "turn_complete", None)]
    second = [("live_1", 2, start + timedelta(seconds=1), "assistant_fragment", "late"), ("live_2", 1, start + timedelta(hours=2), "user_fragment", "hi")]
    third = [("live_2", 2, start + timedelta(hours=4), "user_fragment", "hi")]
    for i, rows in enumerate([first, second, third]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(first, schema)
    query = (
        live_turn_stream(_stream(spark, df, str(tmp_path / "in")))
        .writeStream.format("memory")
        .queryName("ceiling_out")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = {(r["trace_id"], r["event_type"]): r for r in spark.table("ceiling_out").collect()}
    assert rows["live_1", "live_user_transcript"]["text"] == "call [PHONE_NUMBER]"
    assert rows["live_1", "live_user_transcript"]["pii_redacted"]
    assert rows["live_1", "live_late_fragment"]["text"] == "late"
    assert rows["live_1", "live_session_close"]["duration_ms"] == 2000


START = datetime(2024, 1, 1)
FRAGMENTS = "trace_id string, seq long, timestamp timestamp, kind string, text string"


def _at(seconds):
    return START + timedelta(seconds=seconds)


def _live_out(spark, batches, folder, name):
    """The rows of a live stream fed one batch of fragments after the other."""
    for rows in batches:
        spark.createDataFrame(rows, FRAGMENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    df = spark.createDataFrame(batches[0], FRAGMENTS)
    query = (
        live_turn_stream(_stream(spark, df, f"{folder}/in"), lateness="1 hour")
        .writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", f"{folder}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.table(name)


def test_a_closed_session_stays_closed(spark, tmp_path):
    batches = [
        [("live_1", 1, _at(0), "user_fragment", "hello "), ("live_1", 2, _at(1), "tool_call", "search_knowledge_base"),
         ("live_2", 1, _at(0), "user_fragment", "hi"), ("live_3", 1, _at(0), "interrupted", None)],
        [("live_1", 3, _at(2), "assistant_fragment", "yes"), ("live_1", 4, _at(3), "turn_complete", None),
         ("live_1", 5, _at(4), "tool_call", "escalate_to_human"), ("live_1", 6, _at(5), "assistant_fragment", "cut of"),
         ("live_1", 7, _at(6), "interrupted", None), ("live_1", 8, _at(7), "session_close", None),
         ("live_1", 9, _at(8), "user_fragment", "too late, call 555-123-4567")],
        [("live_1", 10, _at(9), "user_fragment", "again"), ("live_1", 11, _at(10), "turn_complete", None),
         ("live_2", 2, _at(700), "user_fragment", "after the ceiling"), ("live_2", 3, _at(30), "turn_complete", None)],
        [("live_4", 1, _at(20_000), "user_fragment", "moves the clock")],
        [("live_2", 4, _at(20_010), "user_fragment", "much later"), ("live_4", 2, _at(20_020), "turn_complete", None)],
    ]
    out = _live_out(spark, batches, tmp_path, "closed_out")
    closes = {r["trace_id"]: r for r in out.where("event_type = 'live_session_close'").collect()}
    assert out.where("event_type = 'live_session_close'").count() == len(closes)  # never a second close
    one = closes["live_1"]
    assert (one["turn"], one["duration_ms"], one["escalated"], one["outcome"], one["closed_at"]) == (1, 7000, True, "escalated", _at(7))
    assert (closes["live_2"]["turn"], closes["live_2"]["duration_ms"], closes["live_2"]["outcome"]) == (1, 30_000, "contained")
    assert closes["live_3"]["turn"] == 1  # one at least
    late = [(r["trace_id"], r["text"]) for r in out.where("event_type = 'live_late_fragment'").collect()]
    assert sorted(late, key=str) == sorted(
        [("live_1", "too late, call [PHONE_NUMBER]"), ("live_1", "again"), ("live_1", None), ("live_2", "after the ceiling"), ("live_2", "much later")],
        key=str,
    )
    tools = [(r["trace_id"], r["tool_name"]) for r in out.where("event_type = 'live_tool_call'").collect()]
    assert sorted(tools) == [("live_1", "escalate_to_human"), ("live_1", "search_knowledge_base")]
    assert out.where("event_type = 'live_interruption'").count() == 2

    summary_of_closes(str(tmp_path / "summaries"))(out, 0)
    summary_of_closes(str(tmp_path / "summaries"))(out, 0)  # replayed
    rows = {r["trace_id"]: r for r in spark.read.parquet(str(tmp_path / "summaries")).collect()}
    assert len(rows) == len(closes)
    assert (rows["live_1"]["modality"], rows["live_1"]["outcome"], rows["live_1"]["turns"], rows["live_1"]["latency_p50_ms"]) == ("voice", "escalated", 1, 7000)


def test_closed_sessions_equal_the_batch_job(spark, sf_dir, tmp_path):
    fragments = c.live_fragments(spark, sf_dir)
    ends = fragments.groupBy("trace_id").agg(F.max("seq").alias("seq"), F.max("timestamp").alias("timestamp"))
    # half of the sessions are closed a turn before their last fragments
    some = ends.where("hash(trace_id) % 2 = 0").select(
        "trace_id", (F.col("seq") - 100_000).alias("seq"), "timestamp", F.lit("session_close").alias("kind"), F.lit("").alias("text")
    )
    starts = fragments.groupBy("trace_id").agg(F.min("seq").alias("seq"), F.min("timestamp").alias("timestamp"))
    handed = starts.where("hash(trace_id) % 3 = 0").select(
        "trace_id", (F.col("seq") + 50_000).alias("seq"), "timestamp", F.lit("tool_call").alias("kind"), F.lit("escalate_to_human").alias("text")
    )
    shut = fragments.unionByName(some.where("seq > 0")).unionByName(handed)
    batches = [[tuple(r) for r in shut.select("trace_id", "seq", "timestamp", "kind", "text").orderBy("seq").collect()]]
    newest = max(r[2] for r in batches[0])
    batches.append([("zz", 1, newest + timedelta(days=30), "user_fragment", "moves the clock")])
    out = _live_out(spark, batches, tmp_path, "twin_out").where("event_type = 'live_session_close' AND trace_id <> 'zz'")
    got = {(r["trace_id"], r["turn"], r["duration_ms"], r["escalated"], r["outcome"], r["closed_at"]) for r in out.collect()}
    twin = live.session_closes(shut).collect()
    assert got == {(r["trace_id"], r["turns"], r["duration_ms"], r["escalated"], r["outcome"], r["closed_at"]) for r in twin}
    assert any(r["late_fragments"] for r in twin) and any(r["escalated"] for r in twin)


def test_rolling_outcomes_equal_batch_for_closed_windows(spark, sf_dir, tmp_path):
    rows = c.conversations(spark, sf_dir)
    _files(rows, str(tmp_path / "in"), 3, "created_at")
    query = (
        ingest.rolling_outcomes(_stream(spark, rows, str(tmp_path / "in")), "1 day")
        .writeStream.format("memory")
        .queryName("rolling_out")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    closed = spark.table("rolling_out")
    assert closed.count() > 20
    assert closed.exceptAll(readout.outcome_windows(rows, "1 day")).count() == 0


def test_refusal_alerts_of_a_stream_equal_the_batch_job(spark, tmp_path):
    rows = []
    for h in range(200):
        for m, channel in enumerate(("voice", "chat")):
            refused = 9 if (h + 7 * m) % 61 == 60 else h % 3 == 0
            rows += [(channel, START + timedelta(hours=h, minutes=i), "refused" if i < refused else "contained") for i in range(12)]
    talks = spark.createDataFrame(rows, "modality string, created_at timestamp, outcome string")
    expected = sorted(map(tuple, readout.refusal_alerts(talks).collect()))
    # spikes, judged by the past alone: the first window of a channel never is one
    assert [(r[0], r[1], r[3]) for r in expected] == sorted(
        [(START + timedelta(hours=h), ch, 9) for ch, m in (("voice", 0), ("chat", 1)) for h in range(200) if (h + 7 * m) % 61 == 60]
    )
    _files(talks, str(tmp_path / "in"), 5, "created_at")
    query = (
        ingest.refusal_alert_stream(_stream(spark, talks, str(tmp_path / "in")))
        .writeStream.format("memory")
        .queryName("alert_out")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("alert_out").collect()))
    assert got == expected  # the spikes are in closed windows


def test_sketches_merge_and_stay_within_their_accuracy(spark, sf_dir, tmp_path):
    talks = c.conversations(spark, sf_dir)
    exact = {r["modality"]: r for r in evaluation.latency_percentiles(talks, ["modality"], "latency_p50_ms").collect()}
    stored = str(tmp_path / "sketches")
    _files(talks, str(tmp_path / "in"), 3, "created_at")
    ingest.sketch_latencies(_stream(spark, talks, str(tmp_path / "in")), stored, str(tmp_path / "ckpt")).awaitTermination()
    merged = readout.merged_percentiles(spark.read.parquet(stored), ["modality"]).collect()
    assert {tuple(r) for r in merged} == {
        tuple(r) for r in readout.merged_percentiles(readout.latency_sketches(talks), ["modality"]).collect()
    }
    for r in merged:
        assert r["measured"] == exact[r["modality"]]["measured"]
        for p in ("latency_p50_ms", "latency_p95_ms"):
            assert abs(r[p] - exact[r["modality"]][p]) <= readout.ACCURACY * exact[r["modality"]][p] + 0.001
    newest = readout.rolling_percentiles(spark.read.parquet(stored), 24 * 366).orderBy(F.desc("window_start")).first()
    assert newest["measured"] == exact[newest["modality"]]["measured"]


def test_incremental_evaluation_judges_each_conversation_once(spark, sf_dir, tmp_path):
    rows = c.conversations(spark, sf_dir)
    events = c.trace_events(spark, sf_dir)
    source = str(tmp_path / "in")
    _files(rows, source, 2, "created_at")
    args = (str(tmp_path / "runs"), str(tmp_path / "ckpt"))
    log = str(tmp_path / "log")
    write_log(events, log)
    evaluate.evaluate_stream(_stream(spark, rows, source), log, *args).awaitTermination()
    evaluate.evaluate_stream(_stream(spark, rows, source), log, *args).awaitTermination()  # nothing new
    runs = spark.read.schema(EVAL_RUNS).parquet(f"{args[0]}/batch_id=*")
    judged = evaluate.turns_to_judge(rows, events).count()
    assert runs.count() == 2
    assert runs.agg(F.sum("sample_size")).first()[0] == judged
    assert runs.where("refusal_precision IS NOT NULL").count() == 0


def test_a_batch_reads_only_the_days_of_the_log_it_needs(spark, sf_dir, tmp_path):
    rows, events = c.conversations(spark, sf_dir), c.trace_events(spark, sf_dir)
    log = str(tmp_path / "log")
    write_log(events, log)
    days = listing.partition_values(spark, log, "event_date")
    day = rows.where(F.to_date("created_at") == days[10])
    near = evaluate.log_around(spark, log, day)
    assert {f.split("event_date=")[1][:10] for f in near.inputFiles()} == set(days[9:12])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(evaluate.turns_to_judge(day, near)) == key(evaluate.turns_to_judge(day, events)) != []
    assert evaluate.log_around(spark, log, day.where("false")).count() == 0


def test_replies_are_verified_after_the_turn(spark, tmp_path):
    schema = "trace_id string, turn long, event_type string, text string"
    log = spark.createDataFrame(
        [
            ("live_1", 1, "live_user_transcript", "my blue drill order is late"),
            ("live_1", 1, "live_assistant_text", "Your blue drill order is late. It was eaten by wolves yesterday night."),
            ("live_2", 1, "live_assistant_text", "Nobody asked about this reply here."),
        ],
        schema,
    )
    verify_after_turn(log, str(tmp_path))(log.where("trace_id = 'live_1'"), 0)
    row = spark.read.parquet(f"{tmp_path}/batch_id=0").collect()
    assert [(r["trace_id"], r["claims"], r["supported"], r["verdict"]) for r in row] == [("live_1", 2, 1, "fail")]


def test_replies_are_verified_on_tool_results(spark, tmp_path):
    call = '{"tool_name": "search_knowledge_base", "result_preview": "The blue drill ships tomorrow, ask 555-123-4567."}'
    fragments = [
        ("live_1", 1, _at(0), "user_fragment", "Does my red saw come with a free case?"), ("live_1", 2, _at(1), "tool_call", call),
        ("live_1", 3, _at(2), "assistant_fragment", "The blue drill ships tomorrow. My red saw come with a free case."),
        ("live_1", 4, _at(3), "turn_complete", None), ("live_1", 5, _at(4), "tool_call", "escalate_to_human"),
        ("live_1", 6, _at(5), "session_close", None),
    ]
    out = _live_out(spark, [fragments], tmp_path, "tool_out")
    out = spark.createDataFrame(out.collect(), out.schema)
    tools = {r["tool_name"]: (r["text"], r["pii_redacted"]) for r in out.where("event_type = 'live_tool_call'").collect()}
    assert tools == {
        "search_knowledge_base": ("The blue drill ships tomorrow, ask [PHONE_NUMBER].", True), "escalate_to_human": (None, False)
    }
    batch = live.tool_calls(spark.createDataFrame(fragments, FRAGMENTS)).orderBy("seq").collect()
    assert [r["tool_name"] for r in batch] == ["search_knowledge_base", "escalate_to_human"] and batch[1]["result_preview"] is None
    assert live.session_closes(spark.createDataFrame(fragments, FRAGMENTS)).first()["escalated"]
    for evidence, supported in ((("tool", "customer"), 2), (("tool",), 1)):
        folder = str(tmp_path / str(supported))
        verify_after_turn(out, folder, evidence)(out, 0)
        row = spark.read.parquet(f"{folder}/batch_id=0").first()
        assert (row["claims"], row["supported"]) == (2, supported)


def test_quarantined_rows_are_kept_with_their_rules(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = [("e1", "trc_1", "stt", None, "{}"), ("e2", "trc_1", None, None, "{bad"), ("e3", "trc_1", "user_message", " ", "{}")]
    log = spark.createDataFrame(rows, "event_id string, trace_id string, event_type string, input_text string, metadata string")
    _files(log, source, 2, "event_id")
    ingest.quarantine_log(_stream(spark, log, source), out, ckpt).awaitTermination()
    kept = {r["event_id"]: list(r["violations"]) for r in spark.read.parquet(out).collect()}
    assert kept == {"e2": ["event_type_enum", "metadata_json"], "e3": ["blank_user_message"]}
