import json
import os

from pyspark.sql import functions as F

from wattshift.sources import samples as src
from wattshift.sources.results import result_json, write_results

DATA = os.path.join(os.path.dirname(__file__), "data")


def decoded(spark, text, on_bad="skip"):
    df = src.parse_batches(spark.createDataFrame([(text,)], "value string"))
    return [(r["i"], r["voltage"], r["current"]) for r in src.decode_records(df, on_bad).collect()]


def test_numbers_and_numeric_text(spark):
    text = '{"records":[{"i":1,"voltage":2.5,"current":"3"},{"i":"2","voltage":"-1e3","current":0}]}'
    assert decoded(spark, text) == [(1, 2.5, 3.0), (2, -1000.0, 0.0)]


def test_bad_record_ends_or_is_skipped(spark):
    rows = [{"i": k, "voltage": "x" if k in (2, 4) else 1.0, "current": 1} for k in range(6)]
    text = json.dumps({"records": rows})
    assert [r[0] for r in decoded(spark, text, "stop")] == [0, 1]
    assert [r[0] for r in decoded(spark, text)] == [0, 1, 3, 5]
    first_bad = json.dumps({"records": rows[2:]})
    assert decoded(spark, first_bad, "stop") == []
    df = src.parse_batches(spark.createDataFrame([(text,)], "value string"))
    bad = src.decode_records(df, "keep").filter(~F.col("good")).collect()
    assert [r["i"] for r in bad] == [2, 4]


def test_end_mark_and_garbage_are_empty(spark):
    assert decoded(spark, '{"records":""}') == []
    assert decoded(spark, "no json") == []
    df = spark.createDataFrame([('{"records":""}',), ('{"records":[]}',)], "value string")
    assert [r[0] for r in df.select(src.ends_stream()).collect()] == [True, False]


def test_nothing_unreadable_vanishes(spark, tmp_path):
    texts = ['{"stream_id":1,"batch_no":0,"records":[{"i":1,"voltage":2,"current":3},{"i":2,"voltage":"x","current":3}]}',
             '{"stream_id":1,"batch_no":1,"records":[{"i":', "garbage", '{"stream_id":1,"batch_no":2,"records":5}', '{"stream_id":1,"batch_no":3,"records":""}']
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(str(tmp_path / "wire"))
    assert [tuple(r) for r in src.read_batches(spark, str(tmp_path / "wire")).collect()] == [(1, 0, 1, 2.0, 3.0)]
    bad = src.quarantine(src.wire_batches(spark.read.text(str(tmp_path / "wire")))).collect()
    assert sorted(r["value"] for r in bad) == sorted(texts[:4])


def test_equal_arrays_stay_apart_and_broken_ones_are_told(spark, tmp_path):
    spark.createDataFrame([(t,) for t in ("[[1,2],[3,4]]", "[[1,2],[3,4]]", "[[1,")], "value string").coalesce(1).write.text(str(tmp_path / "a"))
    rows = src.read_feature_arrays(spark, str(tmp_path / "a"), whole_file=False).collect()
    assert len(rows) == len({(r["path"], r["series"], r["idx"]) for r in rows}) == 4
    assert [r["value"] for r in src.read_feature_arrays(spark, str(tmp_path / "a"), False, broken=True).collect()] == ["[[1,"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(k, k / 7, -k * 1e-9) for k in range(50)]
    df = spark.createDataFrame(rows, src.CSV_SCHEMA)
    df.write.csv(str(tmp_path / "csv"), header=False)
    assert sorted(tuple(r) for r in src.read_csv(spark, str(tmp_path / "csv")).collect()) == rows


def test_feature_array_file(spark):
    df = src.read_feature_arrays(spark, os.path.join(DATA, "window_352.json"))
    with open(os.path.join(DATA, "window_352.json")) as f:
        want = [tuple(p) for p in json.load(f)]
    assert [(r["f1"], r["f2"]) for r in df.orderBy("idx").collect()] == want


def test_wire_batches_round_trip(spark, tmp_path):
    rows = [(s, i // 5, i, i / 3, i / 7) for s in range(2) for i in range(23)]
    df = spark.createDataFrame(
        rows, "stream_id long, batch_no long, i long, voltage double, current double"
    )
    src.to_batches(df).write.text(str(tmp_path / "wire"))
    got = src.read_batches(spark, str(tmp_path / "wire"))
    assert sorted(tuple(r) for r in got.select(*df.columns).collect()) == rows


def test_results_as_json(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, 5, True, 3), (0, 6, False, -1)], "stream_id long, s long, d boolean, event_s long"
    )
    got = {r["s"]: r["json"] for r in result_json(df).collect()}
    assert got[5] == '{"s":5,"d":true,"event_s":3}' and got[6] == '{"s":6,"d":false,"event_s":-1}'
    write_results(df, str(tmp_path / "out"), ordered=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
