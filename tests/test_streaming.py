from pyspark.sql import functions as F

from demandara.operators.demand import daily_demand
from demandara.queries import fixtures as fx
from demandara.streaming.daily import (append_daily, daily_demand_stream, merge_batch, read_kept,
                                       upsert_daily)


def test_closed_days_equal_the_batch_totals(spark, sf, tmp_path):
    events = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("codigo"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("cantidad"))
    src = str(tmp_path / "in")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    query = append_daily(daily_demand_stream(stream, late="1 hour"), str(tmp_path / "out"),
                         str(tmp_path / "chk"))
    query.awaitTermination(120)
    got = {(r.series_id, r.fecha): r.cantidad
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = daily_demand(events.withColumn("fecha", F.to_date("ts")))
    expected = {(r.series_id, r.fecha): r.cantidad for r in batch.collect()}
    last = max(f for _, f in expected)
    assert got == {k: v for k, v in expected.items() if k[1] < last}


def totals(df):
    return {(r.series_id, r.fecha): r.cantidad for r in df.collect()}


def test_kept_table_after_replayed_and_late_batches(spark, sf, tmp_path):
    events = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("codigo"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("cantidad"))
    parts = [events.where(F.pmod(F.hash("ts", "cantidad"), F.lit(4)) == k) for k in range(4)]
    path = str(tmp_path / "kept")
    assert read_kept(spark, path).count() == 0
    for k, rows in enumerate(parts):  # days of every part come again in all later ones
        merge_batch(rows, k, path)
        once = totals(read_kept(spark, path))
        merge_batch(rows, k, path)
        assert totals(read_kept(spark, path)) == once
    merge_batch(parts[1], 1, path)  # an old batch, long in the totals
    merge_batch(events.limit(0), 4, path)
    expected = totals(daily_demand(events.withColumn("fecha", F.to_date("ts"))))
    assert totals(read_kept(spark, path)) == expected
    odd = spark.createDataFrame([(None, "2020-01-01 00:00:00", 5), ("x", None, 5),
                                 ("new", "2020-01-01 10:00:00", None)],
                                "codigo string, ts string, cantidad long").withColumn(
        "ts", F.to_timestamp("ts"))
    merge_batch(odd, 5, path)
    new = totals(read_kept(spark, path))
    assert len(new) == len(expected) + 1 and [v for k, v in new.items() if k[0] == "new"] == [0.0]


def test_a_batch_cut_off_between_two_days_is_finished_by_its_repeat(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2),
                                  ("b", "2024-01-02", 3)], "codigo string, ts string, cantidad long")
    path = str(tmp_path / "kept")
    merge_batch(rows, 0, path)
    merge_batch(rows.where("ts = '2024-01-01'"), 1, path)  # as if the second folder was not reached
    merge_batch(rows, 1, path)
    assert {(k[0], str(k[1])): v for k, v in totals(read_kept(spark, path)).items()} == {
        ("a", "2024-01-01"): 2, ("a", "2024-01-02"): 4, ("b", "2024-01-02"): 6}


def test_kept_table_over_a_stream(spark, sf, tmp_path):
    events = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("codigo"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("cantidad"))
    src, path = str(tmp_path / "in"), str(tmp_path / "kept")
    halves = events.where("cantidad % 2 = 0"), events.where("cantidad % 2 <> 0")
    for half in halves:  # the second run goes on where the first one stopped
        half.write.mode("append").parquet(src)
        upsert_daily(spark.readStream.schema(events.schema).parquet(src), path,
                     str(tmp_path / "chk")).awaitTermination(120)
    kept = totals(read_kept(spark, path))
    assert kept == totals(daily_demand(halves[0].unionByName(halves[1])
                                       .withColumn("fecha", F.to_date("ts"))))
