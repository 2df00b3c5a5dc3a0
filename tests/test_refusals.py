"""The stateful stream of refusals against the batch form, over restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memloom.operators.tenancy import admit
from memloom.streaming.refusals import run_refusals

SCHEMA = "team_id string, id long, ts timestamp, note string"


def test_restarted_stream_equals_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 30)
    rows = [(f"t{i % 3 if i % 4 else 0}", i, start + timedelta(hours=i), "n") for i in range(140)] + [("t0", 1000 + i, start + timedelta(hours=5), "tie") for i in range(5)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    made = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):  # each restart goes on where the last ended
        made.where(F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(start))) / (3600 * 50)) == part).coalesce(2).write.mode("append").parquet(source)
        run_refusals(spark.readStream.schema(SCHEMA).parquet(source), 15, out, checkpoint)
    run_refusals(spark.readStream.schema(SCHEMA).parquet(source), 15, out, checkpoint)  # nothing new
    got = {(r.id, r.period, r.admitted) for r in spark.read.parquet(out).collect()}
    want = {(r.id, r.period, r.admitted) for r in admit(made.withColumn("period", F.date_format("ts", "yyyy-MM")), 15, ["ts", "id"]).collect()}
    assert got == want and spark.read.parquet(out).count() == len(rows)
    # a request for a period that the watermark has passed is refused; caps of the rows go first, 0 admits all
    late = [("t0", 2000, start, 0), ("t9", 2001, start + timedelta(days=20), 1), ("t9", 2002, start + timedelta(days=20, hours=1), 1), *(("free", 3000 + i, start + timedelta(days=20), 0) for i in range(30))]
    spark.createDataFrame(late, "team_id string, id long, ts timestamp, cap int").write.parquet(source + "2")
    spark.createDataFrame([("t0", 1, start + timedelta(days=40), 5)], "team_id string, id long, ts timestamp, cap int").write.mode("append").parquet(source + "2")
    for _ in range(2):
        run_refusals(spark.readStream.schema("team_id string, id long, ts timestamp, cap int").option("maxFilesPerTrigger", 100).parquet(source + "2"), 1, out + "2", checkpoint + "2")
        spark.createDataFrame([("t9", 2003, start + timedelta(days=20), 1), ("t0", 2, start + timedelta(days=41), 5)], "team_id string, id long, ts timestamp, cap int").write.mode("append").parquet(source + "2")
    got = {r.id: r.admitted for r in spark.read.parquet(out + "2").collect()}
    assert [got[k] for k in (2000, 2001, 2002, 3029, 1)] == [True, True, False, True, True] and not got.get(2003) and got[2] is True
