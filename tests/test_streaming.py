"""Structured Streaming operators: dedup within the watermark, exactly-once across restarts,
windowed monitor equals the batch aggregate over closed windows."""

import subprocess

from pyspark.sql import functions as F

from vulnsift.streaming import append as st


def scratch():
    return subprocess.check_output(["mktemp", "-d", "/tmp/run-XXXXXX"]).decode().strip()


def rows(spark, n0, n1, think=True):
    text = "<think>x</think>\nSWC: 107" if think else "SWC: 104"
    return spark.range(n0, n1).select(
        F.col("id").alias("completion_id"), F.col("id").alias("contract_id"), F.lit(0).alias("k"),
        F.lit("policy").alias("model"), F.lit(text).alias("text"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("arrived_at"))


def test_append_dedup_and_restart(spark):
    base = scratch()
    first = rows(spark, 0, 50)
    first.unionByName(rows(spark, 0, 10)).unionByName(rows(spark, 50, 60, think=False)).write.mode("append").json(f"{base}/in")
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    out = spark.read.schema(st.COMPLETION_EVENTS).parquet(f"{base}/out")
    assert out.count() == 50 and out.select("completion_id").distinct().count() == 50
    # restart on the same checkpoint: nothing new, nothing written twice
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    assert spark.read.schema(st.COMPLETION_EVENTS).parquet(f"{base}/out").count() == 50
    # new arrivals are processed once
    rows(spark, 100, 120).write.mode("append").json(f"{base}/in")
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    assert spark.read.schema(st.COMPLETION_EVENTS).parquet(f"{base}/out").count() == 70


def test_monitor_matches_batch_on_closed_windows(spark):
    base = scratch()
    ev = spark.range(0, 2000).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"),
        (F.col("id") % 7).cast("double").alias("value"))
    ev.write.parquet(f"{base}/in")
    st.run_monitor(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", window="1 day", delay="2 days")
    got = {(r.window_start, r.event_type): (r.n, round(r.mean_value, 9))
           for r in spark.read.parquet(f"{base}/out").collect()}
    max_ts = ev.agg(F.max("ts")).first()[0]
    batch = (ev.groupBy(F.window("ts", "1 day").alias("w"), "event_type")
             .agg(F.count("*").alias("n"), F.avg("value").alias("m"))
             .where(F.col("w.end") <= F.lit(max_ts) - F.expr("INTERVAL 2 DAYS")))
    want = {(r.w.start, r.event_type): (r.n, round(r.m, 9)) for r in batch.collect()}
    assert got == want and len(want) > 0


def test_alarms_over_batches_restart_and_late_rows(spark):
    """Day means 10, 10, 25, 9, 21, ...: alarms above twice the first; a restart keeps the first mean, late rows change nothing."""
    from vulnsift.streaming import alarm as al
    base = scratch()

    def day(n, length, rows=3):
        return spark.range(rows).select(F.lit("e").alias("experiment"), F.lit("s").alias("stage"),
                                        F.timestamp_seconds(F.lit(1_704_067_200 + 86_400 * n) + F.col("id") * 3600).alias("ts"),
                                        F.lit(float(length)).alias("mean_length"), (F.col("id") / 2).alias("reward"))

    def add(*days):
        for d in days:
            d.coalesce(1).write.mode("append").parquet(f"{base}/in")
        al.run_alarms(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", delay="1 day")
        out = spark.read.schema(al.ALARMS).parquet(f"{base}/out").orderBy("window_start").collect()
        return [((r.window_start.timestamp() - 1_704_067_200) // 86_400, r.mean_length, r.mean_reward, r.start_length) for r in out]

    assert add(day(0, 10), day(1, 10), day(2, 25), day(3, 9), day(5, 10)) == [(2, 25.0, 0.5, 10.0)]
    assert add() == [(2, 25.0, 0.5, 10.0)]
    # late rows for day 0 and 2 after their windows closed; day 6 exceeds the first mean kept before the restart
    assert add(day(0, 1), day(2, 1000), day(6, 21), day(9, 10)) == [(2, 25.0, 0.5, 10.0), (6, 21.0, 0.5, 10.0)]


def test_append_over_batches_drops_late_rows(spark):
    """A completion that comes again within the delay is dropped in a later run too; one older than the watermark is not taken."""
    base = scratch()
    rows(spark, 0, 20).write.mode("append").json(f"{base}/in")
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", delay="1 hour")
    rows(spark, 15, 20).unionByName(rows(spark, 100_000, 100_010)).write.mode("append").json(f"{base}/in")
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", delay="1 hour")
    rows(spark, 50, 60).write.mode("append").json(f"{base}/in")  # a day before the watermark
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", delay="1 hour")
    ids = sorted(r.completion_id for r in spark.read.schema(st.COMPLETION_EVENTS).parquet(f"{base}/out").collect())
    assert ids == [*range(20), *range(100_000, 100_010)]

