"""Times in forms of any length."""

from loomgrid.operators.timestamps import received_times


def test_blanks_of_any_number(spark):
    """Blanks between date and clock make no difference; a long text that is no time is none."""
    texts = ["2024-01-02" + " " * n + "03:04:05Z" for n in (1, 60, 500)] + ["1" * 70 + " x", "2024-01-02" + " " * 3000 + "x"]
    rows = spark.createDataFrame([(i, 1, 20240102, t) for i, t in enumerate(texts)], "raw_id long, manifest_id int, service_date int, stop_timestamp string")
    zones = spark.createDataFrame([(1, "UTC")], "manifest_id int, zone string")
    found = {r.record_id: r.norm_value for r in received_times(rows, zones).collect()}
    assert found == {0: 1704164645000000, 1: 1704164645000000, 2: 1704164645000000, 3: -1, 4: -1}
