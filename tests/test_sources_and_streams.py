import pytest

from locusframe.sources.tables import append_rows, read_localizations
from locusframe.streaming.events import first_of_each, sessions, sliding_counts, windowed_counts


def test_csv_headers_frames_and_missing_z(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('"Frame","X [nm]","Y [nm]","z [nm]","bkgstd [photon]","uncertainty [nm]","uncertainty_xy [nm]","note"\n1,10,20,0,2,7,8,a\n2,11,21,0,3,7,8,b\n')
    rows = read_localizations(spark, str(p)).orderBy("frame").collect()
    assert [(r.frame, r.x_nm, r.z_nm, r.lpx_nm, r.note) for r in rows] == [(0, 10.0, 0.0, 7.0, "a"), (1, 11.0, 0.0, 7.0, "b")]
    p.write_text("x [nm],y [nm]\n1,2\n")
    with pytest.raises(ValueError):
        read_localizations(spark, str(p))


def test_pixels_need_a_size(spark, tmp_path):
    p = str(tmp_path / "px")
    spark.createDataFrame([(0, 1.0, 2.0)], "frame long, x double, y double").write.parquet(p)
    with pytest.raises(ValueError):
        read_localizations(spark, p)
    assert read_localizations(spark, p, 130.0).first().x_nm == 130.0


def test_append_refuses_other_columns(spark, tmp_path):
    p = str(tmp_path / "t")
    append_rows(spark.range(3), p)
    append_rows(spark.range(2), p)
    assert spark.read.parquet(p).count() == 5
    with pytest.raises(ValueError):
        append_rows(spark.range(2).toDF("other"), p)


def test_windowed_counts_stream(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as event_type, 1.0D as value union all select timestamp'2024-01-01 00:02:00', 'a', 2.0D union all select timestamp'2024-01-01 02:00:00', 'b', 3.0D").coalesce(1).write.parquet(p)
    stream = windowed_counts(spark.readStream.schema(spark.read.parquet(p).schema).parquet(p), "ts")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.sql("select * from counts").collect()] == [("a", 2, 3.0)]


def _drained(spark, stream, name, at):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_sessions_windows_and_repeats_in_streams(spark, tmp_path):
    p = str(tmp_path / "rows")
    rows = [("00:00:00", 1, "a"), ("00:01:00", 1, "a"), ("00:09:00", 1, "b"), ("00:01:00", 2, "a"), ("00:01:30", 2, "a"), ("03:00:00", 9, "z")]
    spark.createDataFrame(rows, "t string, user_id long, event_type string").selectExpr("to_timestamp(concat('2024-01-01 ', t)) as ts", "user_id", "event_type").coalesce(1).write.parquet(p)
    source = lambda: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    found = _drained(spark, sessions(source(), "ts", "5 minutes"), "gaps", tmp_path)
    assert sorted((r.user_id, r.n_locs, r.first.minute) for r in found) == [(1, 1, 9), (1, 2, 0), (2, 2, 1)]
    found = _drained(spark, sliding_counts(source(), "ts", "10 minutes", "5 minutes"), "sliding", tmp_path)
    assert sorted((str(r.start)[11:16], r.event_type, r.n) for r in found if r.event_type != "z" and r.start.day == 1) == [("00:00", "a", 4), ("00:00", "b", 1), ("00:05", "b", 1)]
    found = _drained(spark, first_of_each(source(), "ts", ["user_id", "event_type"]), "firsts", tmp_path)
    assert len(found) == 4
