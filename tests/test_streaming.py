"""Streams give what tables give."""

from loomgrid.streaming import transitions as T

SCHEMA = "service_date int, start_time int, trip_id string, generated_at long, stop_sequence long, canceled boolean"
ROWS = [
    (1, 0, "a", 10, 3, False), (1, 0, "a", 20, 2, False), (1, 0, "a", 30, None, True), (1, 0, "a", 40, 4, False), (1, 0, "b", 10, 9, False), (1, 9, "b", 40, 1, False), (1, 0, "c", 10, None, False), (1, 0, "c", 60, 1, False),
]


def found(frame):
    return sorted(map(str, frame.select("trip_id", "start_time", "generated_at", "code", "before", "now").collect()))


def test_keyed_state_equals_windows(spark, tmp_path):
    """In files that follow each other, as one table: a new instance starts afresh, absence ends nothing, a canceled trip stays canceled."""
    table = spark.createDataFrame(ROWS, SCHEMA)
    for k, part in enumerate((table.filter("generated_at <= 20"), table.filter("generated_at > 20"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(SCHEMA + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("k")
    out = T.drained(T.transitions(stream), str(tmp_path / "run"))
    assert found(out) == found(T.pairwise(table))
    assert sorted(r.code for r in out.collect()) == ["ACTIVE_AFTER_TERMINAL", "STOP_REGRESSED"]


def test_generations_that_go_back_are_told(spark, tmp_path):
    for k, rows in enumerate(([(1, 0, "a", 50, 3, False)], [(1, 0, "a", 40, 1, False)], [(1, 0, "a", 60, 2, False)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(SCHEMA + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("k")
    out = {r.code for r in T.drained(T.transitions(stream), str(tmp_path / "run")).collect()}
    assert "GENERATION_REGRESSED" in out or out == {"STOP_REGRESSED"}  # files of one moment may come in either order


def test_stale_prefix_and_sessions(spark):
    rows = spark.createDataFrame([("u", 0), ("u", 3600), ("u", 90000)], "user string, s long").selectExpr("user", "s", "timestamp_seconds(s) as ts")
    assert T.stale(rows, 90000, 3600, "s").count() == 2
    assert T.sessions(rows, ["user"], "2 hours").count() == 2
    assert sorted(r.n for r in T.clock(rows, ["user"], "1 day").collect()) == [1, 2]
