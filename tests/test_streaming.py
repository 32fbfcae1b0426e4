"""The settle-or-time-out gate as a stream, fed file by file."""

from folkmoot.streaming.settle import settled_days

SCHEMA = "day string, at timestamp, meeting_id string, has_summaries boolean, expected int"


def test_days_settle_when_complete_or_after_a_week(spark, tmp_path):
    src = str(tmp_path / "in")

    def put(*rows):
        spark.createDataFrame(rows, "day string, at string, meeting_id string, has_summaries boolean, expected int").selectExpr("day", "cast(at AS timestamp) AS at", "meeting_id", "has_summaries", "expected").coalesce(1).write.mode("append").parquet(src)

    put(("2025-06-01", "2025-06-01 12:00:00", "a", True, 2), ("2025-06-02", "2025-06-02 12:00:00", "c", False, 1))
    q = settled_days(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        put(("2025-06-01", "2025-06-03 12:00:00", "b", True, 2), (None, "2025-06-03 12:00:00", "z", True, 1))
        q.processAllAvailable()
        put(("2025-06-20", "2025-06-20 12:00:00", "e", False, 1))
        q.processAllAvailable()
        put(("2025-06-20", "2025-06-20 13:00:00", "e", True, 1))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["day"], r["meetings"], r["reason"]) for r in spark.table("settled").collect()}
    assert got == {("2025-06-01", 2, "complete"), ("2025-06-02", 0, "time"), ("2025-06-20", 1, "complete")}
