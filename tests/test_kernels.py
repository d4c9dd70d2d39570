"""Order-dependent kernels and files, by hand."""

from test_mobility import fixes

from trekmill.operators import kernels
from trekmill.sources import files


def test_walks(spark):
    df = fixes(spark, [("a", 0, 0, 0.0, 0.0), ("a", 1, 0, 0.0, 0.001), ("a", 2, 0, 50.0, 0.0), ("a", 3, 0, 0.0, 0.002), ("a", 4, 0, None, 0.0), ("b", 0, 0, 1.0, 1.0)])
    assert [r["event_id"] for r in kernels.filter_speed(df).orderBy("event_id").collect()] == [0, 1, 3, 5]
    assert kernels.compress(df.where("event_id <> 2"), 0.3).where("uid = 'a'").first()["lng"] == 0.001
    assert [r["event_id"] for r in kernels.simplify_min_distance(df.where("event_id <> 2"), 0.15).orderBy("event_id").collect()] == [0, 3, 5]
    assert [r["event_id"] for r in kernels.simplify_min_time(df, 7200).orderBy("event_id").collect()] == [0, 2, 3, 5]
    assert kernels.compress(df.where("false")).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "uid string, lat double")
    for name in ("t.parquet", "t.csv"):
        files.write(df, f"{tmp_path}/{name}")
        assert [tuple(r) for r in files.read(spark, f"{tmp_path}/{name}", schema=None if "parquet" in name else "uid string, lat double").collect()] == [("a", 1.5)]
    (tmp_path / "007").mkdir()
    (tmp_path / "007" / "x.plt").write_text("head\nWGS 84\n39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\nx,116.3,0,492,39744.1,2008-10-23,02:53:04\n")
    got = files.read_geolife(spark, str(tmp_path)).collect()
    assert [(r["uid"], r["lat"], str(r["datetime"])) for r in got] == [("007", 39.9, "2008-10-23 02:53:04")]
