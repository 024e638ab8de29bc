"""Histories sent through stores and streams agree with the batch jobs."""

from pyspark.sql import functions as F

from turnledger.plans import live, readout, traces
from turnledger.sources import canonical as c
from turnledger.streaming import backfill


def _same(one, two):
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_the_log_holds_every_event_once(spark, sf_dir):
    events = c.trace_events(spark, sf_dir).where("hash(trace_id) % 3 = 0")
    k = F.pmod(F.hash("event_id"), F.lit(5))
    log, aside = backfill.log_backfill(events, twice=k < 2, broken=k == 1)
    assert _same(log.drop("event_date"), events)
    assert log.where(F.col("event_date") != F.to_date("timestamp")).isEmpty()
    torn = events.where(k == 1).count()
    assert torn > 0 and aside.count() == torn and aside.where("_corrupt_record IS NULL").isEmpty()
    none, nothing = backfill.log_backfill(events.where("false"), twice=k < 2, broken=k == 1)
    assert none.isEmpty() and nothing.isEmpty()


def test_summaries_do_not_depend_on_the_batches(spark, sf_dir):
    log = c.summary_log(spark, sf_dir).where("hash(trace_id) % 4 = 0")
    expected = traces.collapse_summaries(log)
    for batches, fan_in in ((1, 2), (5, 2), (3, 8)):
        assert _same(backfill.summary_backfill(log, batches, fan_in), expected)


def test_only_windows_behind_the_watermark_are_written(spark, sf_dir):
    talks = c.conversations(spark, sf_dir)
    rows = backfill.outcome_backfill(talks, "1 day", "1 day")
    whole = readout.outcome_windows(talks, "1 day")
    assert rows.exceptAll(whole).isEmpty()
    open_days = {r[0][:10] for r in whole.exceptAll(rows).select("window_start").collect()}
    last = talks.agg(F.max("created_at")).first()[0].date()
    assert open_days and all((last - type(last).fromisoformat(day)).days <= 1 for day in open_days)


def test_live_turns_and_closes(spark, sf_dir):
    fragments = c.live_fragments(spark, sf_dir)
    got = backfill.live_backfill(fragments)
    inside = live.bounded_sessions(fragments).where("in_session").drop("in_session")
    names = ["trace_id", "segment", "turn", "event_type", "text", "pii_redacted", "preview"]
    turns = got.where(F.col("event_type").isin("live_user_transcript", "live_assistant_text", "live_interruption"))
    assert _same(turns.select(names), live.assemble_turns(inside).select(names))
    closed = got.where("event_type = 'live_session_close'")
    closed = closed.select("trace_id", F.col("turn").alias("turns"), "duration_ms", "escalated", "outcome", "closed_at")
    batch = live.session_closes(fragments).select(closed.columns)
    assert not closed.isEmpty() and closed.exceptAll(batch).isEmpty()
    # the clock has not reached the ceiling of what is still open
    last = fragments.agg(F.max("timestamp")).first()[0]
    began = fragments.groupBy("trace_id").agg(F.min("timestamp").alias("at"))
    still = batch.join(closed, "trace_id", "left_anti").join(began, "trace_id")
    assert still.where(F.col("at") <= F.lit(last) - F.expr("INTERVAL 20 MINUTES")).isEmpty()
