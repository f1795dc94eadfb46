"""Readers, writers, streams and the staged pipeline."""

import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.sources import edf, recording_bin, sinks, text_formats


def test_recording_round_trip_in_chunks(spark, tmp_path):
    spark.dataSource.register(recording_bin.RecordingBinSource)
    rng = np.random.default_rng(1)
    ecg, ppg = rng.normal(size=1000), rng.normal(size=400)
    recording_bin.write_recording(str(tmp_path / "7_1.bin"), 100.0, 40.0, 30.0, {"ecg1": ecg, "ppg": ppg, "sleep": [0.0, 2.0]})
    df = spark.read.format("recording_bin").option("path", str(tmp_path / "*.bin")).option("chunkSeconds", "3").load()
    counts = {r["channel"]: r["count"] for r in df.groupBy("channel").count().collect()}
    assert counts == {"ecg1": 4, "ppg": 4, "sleep": 2}
    long = recording_bin.long_samples(df).where("channel = 'ecg1'").orderBy("idx").collect()
    assert [r["value"] for r in long] == ecg.tolist() and [r["idx"] for r in long] == list(range(1000))
    only = spark.read.format("recording_bin").option("path", str(tmp_path / "*.bin")).option("channels", "ppg").load()
    assert {r["channel"] for r in only.collect()} == {"ppg"}
    (tmp_path / "short.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="too short"):
        spark.read.format("recording_bin").option("path", str(tmp_path / "short.bin")).load().collect()


def test_counted_files(spark, tmp_path):
    bins = [[np.array([1.0, 2.0]), np.array([3.0]), np.array([])], [np.array([]), np.array([4.0, 5.0]), np.array([0.0])]]
    (tmp_path / "r.bin").write_bytes(recording_bin.counted_bytes(bins))
    (tmp_path / "none.bin").write_bytes(recording_bin.counted_bytes([]))
    got = recording_bin.read_counted(spark, str(tmp_path), ["ppg", "ecg", "sleep"]).orderBy("seg_id").collect()
    assert [tuple(r) for r in got] == [("r", 0, [1.0, 2.0], [3.0], []), ("r", 1, [], [4.0, 5.0], [0.0])]


def test_edf_round_trip(spark, tmp_path):
    spark.dataSource.register(edf.EdfSource)
    t = np.arange(500) / 50
    ecg, spo2 = np.sin(t), 90 + np.arange(10.0)
    edf.write_edf(str(tmp_path / "x.edf"), {"EKG 1": (50.0, ecg), "SpO2": (1.0, spo2)})
    df = spark.read.format("edf_signals").option("path", str(tmp_path / "*.edf")).option("chunkSeconds", "4").load()
    got = recording_bin.long_samples(df)
    x = [r["value"] for r in got.where("channel = 'EKG1'").orderBy("idx").collect()]
    assert np.abs(np.array(x) - ecg).max() < 1e-4
    only = spark.read.format("edf_signals").option("path", str(tmp_path / "*.edf")).option("signals", "spo2").load()
    assert {(r["channel"], r["fs"]) for r in only.select("channel", "fs").collect()} == {("SpO2", 1.0)}
    assert [edf.unit_of(n) for n in ("PPG", "SpO2", "ABP", "EKG")] == ["", "%", "mmHg", "mV"]


def test_delimited_signal(spark, tmp_path):
    (tmp_path / "7_1.dat").write_text('comment\n"Index","ECG II","Pleth"\n0,1.5,9\n1,bad,8\n2,,7\n3,2.5,6\n')
    (tmp_path / "7_2.dat").write_text("nothing\n1,2,3\n")
    got = text_formats.read_delimited_signal(spark, str(tmp_path), "ecg").orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("7_1", 0, 1.5), ("7_1", 3, 2.5)]


def test_sleep_xml(spark, tmp_path):
    (tmp_path / "7_1.xml").write_text(
        "<C><EpochLength>30</EpochLength><SleepStages><SleepStage>0</SleepStage><SleepStage>5</SleepStage></SleepStages>"
        "<ScoredEvents><ScoredEvent><Name>Apnea</Name><Start>1.5</Start><Duration>10</Duration></ScoredEvent></ScoredEvents></C>"
    )
    stages, events = text_formats.read_sleep_xml(spark, str(tmp_path))
    assert [tuple(r) for r in stages.orderBy("epoch_no").collect()] == [("7_1", 0, 0, 30.0), ("7_1", 1, 5, 30.0)]
    assert [tuple(r) for r in events.collect()] == [("7_1", "Apnea", 1.5, 10.0)]


def test_noise_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    head = "start_sample,end_sample,start_sec,end_sec,label, marking_type\n"
    (tmp_path / "csv" / "7_1.csv").write_text(head + "1,20,0.010,0.200,PPG, AF\n")
    (tmp_path / "csv" / "7_2.csv").write_text(head)
    got = text_formats.read_noise_csv(spark, str(tmp_path / "csv")).collect()
    assert [tuple(r) for r in got] == [("7_1", 1, 20, 0.01, 0.2, "PPG", "AF")]
    (tmp_path / "n.bin").write_bytes(struct.pack("<Q6d", 1, 1, 20, 0.01, 0.2, 2, 5))
    assert [tuple(r)[1:] for r in text_formats.read_noise_binary(spark, str(tmp_path / "n.bin")).collect()] == [(1, 20, 0.01, 0.2, 2, 5)]
    text_formats.write_noise_csv(text_formats.read_noise_csv(spark, str(tmp_path / "csv")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["start_sec"] == "0.010"


def test_amplifier_export(spark, tmp_path):
    (tmp_path / "a.inf").write_text("Patient = X\nNumber of Channel = 2\nData Sampling Rate = 2 points/second\nChannel Number  Channel Label\n1 II\n2 RESP\n")
    np.arange(10.0).astype("<f8").tofile(tmp_path / "a.bin")
    got = {r["channel"]: (r["fs"], r["samples"]) for r in text_formats.read_amplifier_export(spark, str(tmp_path / "*.inf")).collect()}
    assert got == {"EKG": (2.0, [0.0, 2.0, 4.0, 6.0]), "RESP": (2.0, [1.0, 3.0, 5.0, 7.0])}


def test_settings_and_metadata(spark, tmp_path):
    assert text_formats.read_properties("a = 1 # x\n# b = 2\n c=d=e \nnothing\na = 3") == {"a": "3", "c": "d=e"}
    (tmp_path / "sets.csv").write_text("name,ecg_rate,ppg_rate,note\nBirch,125\nAlder,256,128,x\n")
    assert text_formats.dataset_settings(str(tmp_path / "sets.csv"), "birch") == {"name": "Birch", "ecg_rate": "125", "ppg_rate": "125", "note": None}
    with pytest.raises(KeyError):
        text_formats.dataset_settings(str(tmp_path / "sets.csv"), "none")
    (tmp_path / "meta.csv").write_text("id,site_id,flag,extra\n1,2.5,a,z\nx,3,b,z\n")
    got = text_formats.read_metadata(spark, str(tmp_path / "meta.csv"), {"id": "double", "site_id": "double", "flag": "string"})
    assert [tuple(r) for r in got.orderBy("site_id").collect()] == [(1.0, 2.5, "a"), (None, 3.0, "b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0, float("nan")), ("b", 2, 3.0, 4.0)], "rec_id string, beat_no int, area double, height double")
    sinks.write_feature_files(df, str(tmp_path / "f"), ["rec_id", "beat_no"], ["area", "height"], rename={"height": "h"})
    assert {(r["rec_id"], r["feature"], r["value"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("a", "area", 2.0), ("a", "h", None), ("b", "area", 3.0), ("b", "h", 4.0)}
    for _ in range(2):
        sinks.append_windows(df.select("rec_id", "area"), str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 4
    done = str(tmp_path / "done")
    assert sinks.not_done(df, done, ["rec_id"]).count() == 2
    df.where("rec_id = 'a'").write.parquet(done)
    assert [r["rec_id"] for r in sinks.not_done(df, done, ["rec_id"]).collect()] == ["b"]
    status = str(tmp_path / "status")
    for value in ("new", "done"):
        sinks.update_status(spark, status, spark.createDataFrame([("a", value)], "rec_id string, status string"), ["rec_id"])
    assert [tuple(r) for r in spark.read.parquet(status).collect()] == [("a", "done")]
    errors = spark.createDataFrame([("a", None), ("b", "bad")], "rec_id string, error string")
    assert [tuple(r) for r in sinks.split_errors(errors, "error", str(tmp_path / "e")).collect()] == [("a",)]
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_stage_runs_only_what_is_missing(spark, tmp_path):
    from pulseloom.plans.pipeline import run_stage

    seen = []

    def stage(df):
        seen.append(sorted(r["rec_id"] for r in df.collect()))
        return df.withColumn("twice", F.col("x") * 2)

    path = str(tmp_path / "stage")
    work = spark.createDataFrame([("a", 1), ("b", 2)], "rec_id string, x int")
    run_stage(spark, path, work.where("rec_id = 'a'"), stage)
    got = run_stage(spark, path, work, stage)
    run_stage(spark, path, work, stage)
    assert seen == [["a"], ["b"]] and {(r["rec_id"], r["twice"]) for r in got.collect()} == {("a", 2), ("b", 4)}


def test_stream_of_cycles_equals_batch(spark, tmp_path):
    from pulseloom.operators.detect import label_cycles
    from pulseloom.streaming.cycles import label_cycle_stream

    rng = np.random.default_rng(1)
    gaps = rng.choice([0.8, 0.8, 0.8, 0.82, 1.5, 0.5], 90)
    times = np.cumsum(gaps).tolist()
    source = tmp_path / "beats"
    for k in range(3):  # three files, taken one a batch in order
        part = spark.createDataFrame([("a", t) for t in times[k * 30 : k * 30 + 30]], "k string, t double")
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("k string, t double").option("maxFilesPerTrigger", 1).parquet(str(source))
    name = "c" + uuid.uuid4().hex
    query = label_cycle_stream(stream, "k", "t").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = label_cycles(spark.createDataFrame([("a", t) for t in times], "k string, t double"), ["k"], "t")
    key = lambda r: round(r["beat_at"], 6)
    assert [(key(r), r["label"]) for r in sorted(spark.table(name).collect(), key=key)] == [(key(r), r["label"]) for r in sorted(batch.collect(), key=key)]


def test_gap_sessions_on_a_stream(spark, tmp_path):
    from pulseloom.streaming.windows import gap_sessions

    rows = [("a", s) for s in (0, 5, 9, 100, 101, 1000)]
    spark.createDataFrame(rows, "k string, s int").select("k", F.timestamp_seconds("s").alias("at")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "s"))
    name = "s" + uuid.uuid4().hex
    gap_sessions(stream, ["k"], "at", "10 seconds", "10 seconds").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table(name).collect()) == [2, 3]  # the last session is still open
