"""Record functions on streams."""

from pyspark.sql import functions as F

from stratamill.operators import waiting
from stratamill.streaming import observed
from stratamill.streaming import waiting as streamed


def test_observations_of_a_stream(spark, tmp_path):
    rows = [(1, "off"), (2, "running"), (3, "error"), (4, None), (5, "Error"), (6, "transitioning")]
    spark.createDataFrame(rows, "id long, status string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, status string").json(f"{tmp_path}/in")
    query = observed(stream, "off").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r.id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {1: "settled", 2: "pending", 3: "failed", 4: "failed", 5: "failed", 6: "pending"}


def test_waits_on_a_stream(spark, tmp_path):
    """Outcomes of a stream whose observations are late, out of order and repeated are those of the whole table; and a
    machine of which nothing more is heard times out by its timer."""
    from test_records import ASKED, SEEN, waits

    asked, seen, expected = waits(60)
    requests = spark.createDataFrame(asked, ASKED)
    # the last file only moves the watermark on
    parts = [seen[0::3], seen[1::3], seen[2::3], [("bell", 5000.0, None, "off", False, None)], [("bell", 9000.0, None, "off", False, None)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SEEN).withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/k={k}")
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        requests = requests.union(spark.createDataFrame([("bell", "absent", None, "10m", 0.0)], ASKED))
        stream = spark.readStream.schema(SEEN.replace("at double", "at timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = streamed.waited(stream, requests).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    finally:
        spark.conf.unset(store)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    found = {r.wait_id: (r.outcome, r.error, r.polls, r.elapsed_s, r.status) for r in rows}
    assert len(found) == len(rows)
    heard = {o[0] for o in seen}
    assert {w: x for w, x in found.items() if w != "bell"} == {w: x for w, x in expected.items() if w in heard and x[0] != "usage"}
    assert {"timeout", "settled", "failed", "aborted"} == {x[0] for w, x in found.items()} and waiting.MOST_POLLS in {x[2] for x in found.values()}
