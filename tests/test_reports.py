"""Failing reads and reports, and choices that can't be used again."""

from __future__ import annotations

import pytest

from cuesmith.sources import sinks, tables


def test_timing_tables_fail_whole(spark):
    kind = "index string, duration string"
    assert [tuple(r) for r in tables.timings(spark.createDataFrame([("1", "2.5"), ("x", "1")], kind)).collect()] == [(1, 2.5), (None, 1.0)]
    for rows, message in (([], "empty"), ([("1", "2"), ("2", "0")], "bad duration"), ([("1", None)], "bad duration"), ([("1", "abc")], "bad duration")):
        with pytest.raises(Exception, match=message):
            tables.timings(spark.createDataFrame(rows, kind)).select("index").collect()


def test_records_of_csv_with_a_mark_and_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"shot",line\n1,"two\nlines"\n , \n2,\n', encoding="utf-8")
    got = [r["fields"] for r in tables.records(tables.read_strings(spark, f"file://{tmp_path}/a.csv")).collect()]
    assert got == [{"shot": "1", "line": "two\nlines"}, {"shot": "2"}]


def test_reports_survive_their_sound(spark, tmp_path):
    items = spark.range(3).toDF("vec_id")
    pairs = spark.createDataFrame([(0, 1, 0.9, "high"), (0, 2, 0.5, "low"), (1, 2, 0.95, "high")], "left_id long, right_id long, similarity double, level string")
    row = sinks.similarity_report(items, pairs, 0.8, lambda: spark.read.parquet(f"file://{tmp_path}/none")).first()
    assert (row["videos"], row["pairs"], row["high_similarity"], row["audio_pairs"]) == (3, 3, 2, None) and "PATH_NOT_FOUND" in row["audio_error"]
    row = sinks.similarity_report(items, pairs, 0.8, lambda: pairs).first()
    assert (row["audio_pairs"], row["audio_high"], row["audio_error"]) == (3, 2, None)
    assert [r["right_id"] for r in sinks.top_pairs(pairs, 2).collect()] == [2, 1]


def test_selections_are_used_again_only_whole(spark):
    saved = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "gone")], "track string, file string")
    lines = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 0)], "track string, lines long")
    files = spark.createDataFrame([("x",), ("y",), ("y",)], "file string")
    assert {r["track"] for r in sinks.reusable_selections(saved, lines, files, "track").collect()} == {"a"}


def test_contained_names_by_their_rarest_gram(spark):
    from cuesmith.operators.records import containing, match_contained

    names = ["the hall.mp4", "hall.mp4", "long road.mov", "x.mp4", "Kitchen scene.mp4", "scene", ".hidden", "aaaa.mp4"]
    tokens = ["hall", "HALL.mp4", " road ", "kitchen", "the hall at night", "nothing", "", None, "x", "aa", "an x-ray", ".hidden"]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(tokens)], "k int, token string")
    n = spark.createDataFrame([(x, k) for k, x in enumerate(names)] + [("hall.mp4", 99)], "name string, o int")

    def plain(token):
        token = (token or "").strip().lower()
        stem = lambda x: x[: x.rindex(".")] if "." in x[1:] else x
        if token:
            for x in names:
                if token in (x.lower(), stem(x.lower())):
                    return x
            for x in names:
                if token in stem(x.lower()) or stem(x.lower()) in token:
                    return x
        return None

    got = {r["k"]: r["name"] for r in match_contained(t, n, "token", "name", "o", stems=True).collect()}
    assert got == {k: plain(x) for k, x in enumerate(tokens)}
    exact = {r["k"]: r["name"] for r in match_contained(t, n, "token", "name", "o").collect()}
    assert exact[0] == "the hall.mp4" and exact[8] == "x.mp4" and exact[1] is None and exact[6] is None
    many = spark.createDataFrame([(f"take {k} of the very same scene",) for k in range(300)], "l string")
    some = spark.createDataFrame([(f"{k} of the very",) for k in range(300)], "s string")
    assert containing(some, many).count() == sum(f"{k} of the very" in f"take {j} of the very" for k in range(300) for j in range(300))
