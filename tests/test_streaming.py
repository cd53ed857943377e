"""Incremental drains: nothing twice, a limit of batches, and failures that do not stop the rest."""

from pyspark.sql import functions as F

from plenaria.streaming import sessions
from plenaria.streaming.incremental import append_new, drain, windowed_counts


def write(spark, folder, start):
    rows = spark.range(start, start + 5).selectExpr("id", "id % 2 AS kind")
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_drain(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for start in (0, 3, 100):
        write(spark, source, start)
    schema = spark.read.parquet(source).schema
    work = append_new(out, ["id"])
    first = drain(spark, source, schema, work, mark, max_batches=1, files_per_batch=1)
    assert first.batches == 1
    rest = drain(spark, source, schema, work, mark, files_per_batch=1)
    assert rest.batches == 2 and rest.errors == []
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(8), *range(100, 105)]
    assert drain(spark, source, schema, work, mark).rows == 0
    write(spark, source, 104)
    assert drain(spark, source, schema, work, mark).rows == 5
    assert spark.read.parquet(out).count() == 17


def test_failed_batch_is_counted(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    write(spark, source, 0)
    write(spark, source, 10)
    seen = []

    def work(batch, number):
        ids = [r.id for r in batch.collect()]
        if 0 in ids:
            raise ValueError("unsound")
        seen.extend(ids)

    report = drain(spark, source, spark.read.parquet(source).schema, work, mark, files_per_batch=1)
    assert len(report.errors) == 1 and "unsound" in report.errors[0] and sorted(seen) == [10, 11, 12, 13, 14]
    schema = spark.read.parquet(source).schema
    again = drain(spark, source, schema, work, mark)
    assert len(again.errors) == 1 and again.rows == 0  # it fails again and stays
    last = drain(spark, source, schema, lambda batch, number: seen.extend(r.id for r in batch.collect()), mark)
    assert last.rows == 5 and sorted(seen) == [*range(5), *range(10, 15)]
    assert drain(spark, source, schema, work, mark).batches == 0


def test_interrupt_ends_a_drain_with_its_report(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write(spark, source, 0)
    work = append_new(out, ["id"])
    schema = spark.read.parquet(source).schema

    class Interrupted:
        def __init__(self, query):
            self.query = query

        def __getattr__(self, name):
            return getattr(self.query, name)

        def awaitTermination(self):
            self.query.processAllAvailable()
            raise KeyboardInterrupt

    from pyspark.sql.streaming import DataStreamWriter

    start = DataStreamWriter.start
    DataStreamWriter.start = lambda self, *a, **k: Interrupted(start(self, *a, **k))
    try:
        report = drain(spark, source, schema, work, mark)
    finally:
        DataStreamWriter.start = start
    assert report.batches == 1 and report.rows == 5 and spark.read.parquet(out).count() == 5


def test_windows_of_a_stream_drop_late_events(spark, tmp_path):
    """A real stream with a watermark: windows come out when they are over, events later than it are lost."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batches = [[("2024-01-01 10:05", "a", 1.0), ("2024-01-01 10:50", "a", 2.0), ("2024-01-01 11:50", "b", 4.0)], [("2024-01-01 10:55", "a", 8.0), ("2024-01-01 14:30", "b", 16.0)], [("2024-01-01 10:59", "a", 32.0), ("2024-01-01 20:00", "b", 1.0)]]
    for rows in batches:
        made = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        query = windowed_counts(stream).writeStream.outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").option("path", out).start()
        query.awaitTermination()
    got = sorted((str(r.start)[11:16], r.event_type, r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == [("10:00", "a", 3, 11.0), ("11:00", "b", 1, 4.0), ("14:00", "b", 1, 16.0)]


def test_sessions_go_on_over_restarts(spark, tmp_path):
    """Three runs over growing input: repeated events count once, sessions span files and runs, late events are lost."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    runs = [
        [(1, "10:00", 1, 1.0), (2, "10:20", 1, 2.0), (2, "10:20", 1, 2.0), (3, "10:10", 2, 4.0)],
        [(2, "10:20", 1, 2.0), (4, "10:45", 1, 8.0), (5, "10:41", 2, 16.0)],  # an event repeated, a session continued
        [(6, "12:30", 3, 1.0), (7, "10:50", 1, 32.0)],  # an event of a session that is open still
        [(8, "16:00", 3, 1.0), (9, "10:51", 1, 64.0)],  # later than the watermark
        [(10, "23:00", 4, 1.0)],
    ]
    whole = []
    for rows in runs:
        whole += rows
        made = spark.createDataFrame([(i, f"2024-01-01 {t}", u, "a", v) for i, t, u, v in rows], "event_id long, ts string, user_id long, event_type string, value double")
        made.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        found = sessions.run_sessions(spark, source, out, mark)
    got = sorted((r.user_id, str(r.start)[11:16], str(r.end)[11:16], r.n_events, r.total) for r in found.collect())
    assert got == [(1, "10:00", "11:20", 4, 43.0), (2, "10:10", "10:40", 1, 4.0), (2, "10:41", "11:11", 1, 16.0), (3, "12:30", "13:00", 1, 1.0), (3, "16:00", "16:30", 1, 1.0)]
    assert sessions.run_sessions(spark, source, out, mark).count() == 5
    table = spark.createDataFrame([(i, f"2024-01-01 {t}", u, v) for i, t, u, v in whole if i != 9], "event_id long, ts string, user_id long, value double")
    batch = sessions.sessions(table.withColumn("ts", F.to_timestamp("ts"))).filter("user_id < 4")
    assert sorted((r.user_id, str(r.start)[11:16], str(r.end)[11:16], r.n_events, r.total) for r in batch.collect()) == got
