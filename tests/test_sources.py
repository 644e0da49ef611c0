"""Readers and writers on small files, and streams against their batch twins."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import folds
from cuesmith.sources import sinks, spreadsheet, tables
from cuesmith.streaming import feeds

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(rows, shared=("shared text",)):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cs.items()) + "</row>" for r, cs in rows.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()


ROWS = {1: {"A": "path", "B": "text"}, 2: {"A": "/v/a.mp4", "B": 0}, 3: {"A": "/v/b.MOV", "B": "x" * 50}, 4: {"B": "only text"}, 5: {"A": "/v/c.txt", "B": "t"}, 6: {"C": "ignored"}, 7: {"A": "/v/d.mp4"}, 8: {"A": "/v/gone.mp4", "B": "t"}}


def test_workbook_rows_and_verdicts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.xlsx").write_bytes(workbook(ROWS))
    (tmp_path / "in/bad.xlsx").write_bytes(b"no archive")
    cells = spreadsheet.read_workbooks(spark, f"file://{tmp_path}/in")
    assert [r["error"] for r in cells.where("error is not null").collect()] == ["not a workbook"]
    files = spark.createDataFrame([("/v/a.mp4",), ("/v/b.MOV",), ("/v/a.mp4",)], "file string")
    rows = {r["row_number"]: r for r in spreadsheet.task_rows(cells.where("error is null"), files).collect()}
    assert {k: r["verdict"] for k, r in rows.items()} == {2: "ok", 3: "ok", 4: "path_empty", 5: "bad_extension", 7: "text_empty", 8: "not_found"}
    assert rows[2]["text"] == "shared text" and rows[3]["text_preview"] == "x" * 24 + "…" + "x" * 6
    assert [r["value"] for r in spreadsheet.column(cells, "C").collect()] == ["ignored"]


def test_workbook_data_source(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook(ROWS))
    spark.dataSource.register(spreadsheet.WorkbookSource)
    df = spark.read.format("workbook").option("path", str(tmp_path / "one.xlsx")).load()
    assert df.where("row_number = 2").count() == 2


def test_workbook_limits():
    with pytest.raises(ValueError):
        spreadsheet.guard(b"x" * 10, most_bytes=5)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(spreadsheet.MOST_ENTRIES + 1):
            z.writestr(f"f{i}", "x")
    with pytest.raises(ValueError):
        spreadsheet.guard(out.getvalue())


SRT = "1\n00:00:00,000 --> 00:00:04,500\nfirst\nline\n\nbroken\n\n2\n00:00:05,000 --> 00:00:09,250\nsecond\n\n3\n00:00:09,000 --> 00:00:08,000\nbackwards\n\n4\n00:00:10,000 --> 00:00:11,000\n\n"


def test_subtitles_both_ways(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    cues = tables.read_subtitles(spark, f"file://{tmp_path}")
    assert [(r["index"], r["start"], r["end"], r["text"]) for r in cues.orderBy("start").collect()] == [(1, 0.0, 4.5, "first line"), (2, 5.0, 9.25, "second")]
    text = sinks.subtitle_text(cues, "path").first()["content"]
    assert text == "1\n00:00:00,000 --> 00:00:04,500\nfirst line\n\n2\n00:00:05,000 --> 00:00:09,250\nsecond\n"


def test_csv_json_and_inventory(spark, tmp_path):
    (tmp_path / "cues.csv").write_text("﻿file,开始,时长,字幕\na.mp4,1,2.5,hi\nb.mp4,0:01:00,x,\n", encoding="utf-8")
    got = [tuple(r) for r in tables.read_cues_csv(spark, f"file://{tmp_path}/cues.csv").collect()]
    assert got == [("a.mp4", 1.0, 3.5, "hi")]
    for i, body in enumerate(['[{"id": 1}, {"id": 2}]', '{"queue": [{"id": 3}]}', '{"items": [{"id": 4}]}', "broken"]):
        (tmp_path / f"{i}.json").write_text(body)
    assert sorted(r["id"] for r in tables.read_items(spark, f"file://{tmp_path}/*.json", "id: int").collect()) == [1, 2, 3, 4]
    inv = {r["name"]: r for r in tables.inventory(spark, f"file://{tmp_path}", (".csv",), with_hash=True).collect()}
    assert list(inv) == ["cues.csv"] and len(inv["cues.csv"]["sha1"]) == 40
    (tmp_path / "t.csv").write_text("index,duration\n1,2.5\n2,oops\n")
    with pytest.raises(Exception, match="bad duration"):
        tables.read_timings(spark, f"file://{tmp_path}/t.csv").collect()


def test_ordered_csv_parts(spark, tmp_path):
    sinks.write_csv(spark.range(1000).withColumn("t", F.concat(F.lit('a "quoted", '), "id")), f"file://{tmp_path}/out", ["id"])
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    ids = [int(line.split(",")[0]) for p in parts for line in (tmp_path / "out" / p).read_text().splitlines()[1:]]
    assert ids == list(range(1000))
    back = tables.read_strings(spark, f"file://{tmp_path}/out")
    assert back.where("id = '7'").first()["t"] == 'a "quoted", 7'


EVENTS = [(k, i, float(i * 3), kind, None) for k in (1, 2) for i, kind in enumerate(["fail", "fail", "ask", "fail", "ask", "ask", "ask", "ok", "ask", "fail", "fail", "fail", "ask", "ask", "ask", "ask", "fail", "ask"][:: 1 if k == 1 else -1])]
KIND = "key long, seq long, at double, kind string, retry_after double"
SETTINGS = {"failures": 3, "open_seconds": 5.0, "lease": 4.0}


def test_breaker_states(spark, tmp_path):
    b = folds.Breaker(failures=3, open_seconds=30.0, lease=20.0)
    assert [b.on("fail", t) or b.state for t in (0, 1, 2)] == ["closed", "closed", "open"]
    assert b.on("ask", 10) is False and b.on("ask", 32) is True and b.state == "half_open"
    assert b.on("ask", 40) is False and b.on("ask", 53) is False and b.state == "open"
    assert b.on("ask", 84) is True and b.on("ok", 85) is None and b.state == "closed"


def test_breaker_stream_like_replay(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, KIND)
    want = sorted(map(tuple, folds.replay_breaker(df, "key", **SETTINGS).collect()))
    for part in range(3):  # arrives in order of seq, in several files
        df.where(f"seq div 6 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    feeds.breaker_states(stream, "key", **SETTINGS).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(90)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_upsert_stream_keeps_latest(spark, tmp_path):
    rows = [(i % 7, i, f"s{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "task_id long, seq long, status string")
    for part in range(3):
        df.where(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = feeds.upsert_into(f"{tmp_path}/state", "task_id", "seq")
    stream.writeStream.foreachBatch(writer).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = max(os.listdir(tmp_path / "state"), key=lambda n: int(n.split("=")[1]))
    got = sorted(map(tuple, spark.read.schema(df.schema).parquet(f"{tmp_path}/state/{last}").collect()))
    assert got == sorted({r[0]: r for r in rows}.values())


def test_sliding_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (2, "2024-01-01 00:01:30")], "k long, t string").selectExpr("k", "to_timestamp(t) AS at")
    out = feeds.recent_counts(df, "at", "k", "60 seconds", "30 seconds", "1 minute")
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1), (2, 1)]


def test_ladder_recommendation(spark):
    def best(rates, stable=None):
        rows = [(1, c, float(r), True if stable is None else stable[i]) for i, (c, r) in enumerate(rates.items())]
        return folds.recommend(spark.createDataFrame(rows, "m long, concurrency int, rate double, stable boolean"), "m").first()["concurrency"]

    assert best({1: 100, 2: 200, 4: 206}) == 2 and best({1: 100, 2: 200, 4: 350}) == 4
    assert best({1: 100, 2: 200, 4: 900}, [True, True, False]) == 2 and best({1: 100, 2: 1}, [False, False]) == 1 and best({3: 5}) == 3
