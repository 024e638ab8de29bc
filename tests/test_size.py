"""What a task holds, and what moves, when tables grow."""

from pyspark.sql import functions as F

from turnledger.plans import index
from turnledger.session import configure
from turnledger.sources import canonical as c
from turnledger.streaming import backfill, evaluate


def _events(spark, folder, n):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % (20 * 86_400)).cast("timestamp_ntz")
    spark.range(0, n, 1, 2).select(
        F.col("id").alias("event_id"),
        at.alias("ts"),
        (F.col("id") % 97).alias("user_id"),
        F.lit("view").alias("event_type"),
        (F.col("id") % 900 / 10.0).alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_task_unrolls_a_bounded_number_of_events(spark, tmp_path):
    n = 8 * c.EVENTS_PER_TASK
    folder = _events(spark, tmp_path, n)
    for rows, each in ((c.trace_events(spark, folder), F.count_distinct("trace_id")), (c.judge_texts(spark, folder), F.count("*"))):
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(each.alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < 1.5 * c.EVENTS_PER_TASK
    days = c.trace_events(spark, folder).groupBy(F.spark_partition_id()).agg(F.count_distinct(F.to_date("timestamp")).alias("n"))
    assert days.agg(F.max("n")).first()[0] <= 5  # of 20: a task writes few folders


def test_shuffles_start_from_many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert int(configure(spark).conf.get(name)) >= 400 > int(before)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "700")
        assert int(configure(spark).conf.get(name)) == 700
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(name)
        configure(spark)
    name = "spark.sql.files.maxPartitionBytes"
    for given, kept in (("128MB", str(32 << 20)), ("16m", "16m")):
        spark.conf.set(name, given)
        assert configure(spark).conf.get(name) == kept
    spark.conf.unset(name)
    configure(spark)


def test_a_batch_of_a_stream_is_judged_adaptively(spark, sf_dir, monkeypatch):
    seen = []

    def judge(conversations, events, judge=evaluate.turns_to_judge):
        seen.extend(df.sparkSession.conf.get("spark.sql.adaptive.enabled") for df in (conversations, events))
        return judge(conversations, events)

    monkeypatch.setattr(evaluate, "turns_to_judge", judge)
    assert backfill.evaluation_backfill(c.conversations(spark, sf_dir), c.trace_events(spark, sf_dir)).count() == 1
    assert seen == ["true", "true"]


def test_lines_are_sent_compressed(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(backfill, "new_folder", lambda s, name: str(tmp_path / name))
    events = c.trace_events(spark, sf_dir).where("hash(trace_id) % 9 = 0")
    backfill.log_backfill(events, F.lit(False), F.lit(False))
    names = [p.name for p in (tmp_path / "log-backfill/lines").glob("part-*")]
    assert names and all(n.endswith(".gz") for n in names)


def test_words_of_one_identifier_meet_in_one_passage(spark, tmp_path):
    rows = [(1, "ab cd"), (1, "cd ef"), (None, "ab"), (None, "gh ab"), (2, None)]
    index.write_index(spark.createDataFrame(rows, "passage_id long, content string").repartition(3), str(tmp_path))
    table = index.open_index(spark, str(tmp_path))
    found = {(r["term"], p["passage_id"], p["tf"], p["length"], p["distinct_words"]) for r in table.postings.collect() for p in r["postings"]}
    assert found == {("ab", 1, 1, 4, 3), ("cd", 1, 2, 4, 3), ("ef", 1, 1, 4, 3), ("ab", None, 2, 3, 2), ("gh", None, 1, 3, 2)}
    assert table.passages == 5 and table.mean_length == 7 / 5
    assert {r["term"]: r["df"] for r in table.terms.collect()} == {"ab": 2, "cd": 1, "ef": 1, "gh": 1}


def test_postings_are_not_sent_out_again_by_query(spark, tmp_path):
    rows = [(i, f"w{i % 7} x{i % 5} common") for i in range(200)]
    index.write_index(spark.createDataFrame(rows, "passage_id long, content string"), str(tmp_path))
    table = index.open_index(spark, str(tmp_path))
    asked = index.weighted_terms(table, spark.createDataFrame([(1, "w1 common"), (2, "x2 w3")], "query_id long, query string"))
    reached = index.block_bounds(table, asked).where("query_id = 1")
    asked, reached = (spark.createDataFrame(df.collect(), df.schema) for df in (asked, reached))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.score(table, asked, reached)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r["query_id"] for r in found.collect()} == {1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(query_id" not in plan and "SortMergeJoin" not in plan
