"""Files in and out, fingerprints, streams, and errors that must be raised."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import market, portfolio, records
from panelforge.sources import files
from panelforge.streaming import bars


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.write_parquet(df, f"{tmp_path}/p", "k")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    files.write_quarantine(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    (tmp_path / "j.json").write_text('{"k": 1}\n{bad\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_json_lines(spark, f"{tmp_path}/j.json", "k long").collect()
    assert files.fingerprint(df).first() == files.fingerprint(df.orderBy(F.desc("k"))).first()
    assert files.fingerprint(df).first() != files.fingerprint(df.where("k = 1")).first()


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    q = bars.daily_bars(stream, "value", "user_id").writeStream.format("memory").queryName("streamed").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = market.daily_bars(events, "value", "value", "user_id").select("day", "user_id", "open", "high", "low", "close", "n")
    assert sorted(map(tuple, spark.table("streamed").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("policy", ["first_seen", "as_of"])
def test_streamed_revisions_equal_batch(spark, tmp_path, policy):
    """Revisions that arrive in any order over many batches, with ties and null stamps, end as the batch has them; what comes after the watermark changes nothing."""
    rng = random.Random(policy)
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(4)}", day + datetime.timedelta(days=rng.randrange(5)), None if k % 40 == 0 else day + datetime.timedelta(days=rng.randrange(6)), k, float(k)) for k in range(200)]
    rng.shuffle(rows)
    schema = "key string, effective_at timestamp, known_at timestamp, id int, value double"
    for k in range(8):
        spark.createDataFrame(rows[k::8], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sent = {}

    def keep(batch, number):
        sent.update({(r.key, r.effective_at): tuple(r) for r in batch.collect()})

    def drain():
        made = bars.revisions(stream, ["key"], policy, tie="id")
        made.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    drain()
    want = market.resolve_revisions(spark.createDataFrame(rows, schema), ["key"], policy, tie="id")
    assert sent == {(r.key, r.effective_at): tuple(r) for r in want.collect()}
    late = [("k0", day + datetime.timedelta(days=100), day, 900, 1.0)], [("k0", day, day - datetime.timedelta(days=9), -1, 5.0), ("k0", day, day + datetime.timedelta(days=99), -2, 5.0)]
    for k, part in enumerate(late):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/late{k}")
        drain()
    assert sent.pop(("k0", day + datetime.timedelta(days=100)))[3] == 900
    assert sent == {(r.key, r.effective_at): tuple(r) for r in want.collect()}
    with pytest.raises(ValueError, match="policy"):
        bars.revisions(stream, ["key"], "newest")


def test_errors(spark):
    with pytest.raises(Exception, match="unknown suspension marker"):
        spark.createDataFrame([("maybe",)], "m string").select(records.suspended(F.col("m"))).collect()
    with pytest.raises(Exception, match="cap is too small"):
        portfolio.capped_simplex(spark.createDataFrame([("t", "a", 0.5)], "timestamp string, security string, w double"), "w", 0.2).collect()
