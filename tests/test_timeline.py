"""Golden cases of timings, frames, phrases and text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import normal, similar, text, times
from cuesmith.operators import matching, timeline


@pytest.mark.parametrize(
    ("cues", "chars", "total", "want"),
    [
        ([(0.0, 10.0, 8)], [4, 4], 10.0, [5, 5]),
        ([(2.0, 10.0, 8)], [2, 6], 12.0, [4, 8]),
        ([(0.0, 4.0, 5), (6.0, 10.0, 5)], [5, 5], 10.0, [4, 6]),
        ([(0.0, 7.0, 6)], [3, 3], 11.5, [3.5, 8.0]),
        ([(0.0, 10.0, 10)], [1, 1, 1, 1, 1, 1, 1], 10.0, [1, 1, 1, 1, 1, 1, 4]),
        ([(0.0, 3.0, 2)], [1, 1, 1, 1], 4.0, [1.5, 1.5, 0, 1]),
    ],
)
def test_quota_durations(spark, cues, chars, total, want):
    c = spark.createDataFrame([("a", *x) for x in cues], "track string, start double, end double, chars long")
    lines = spark.createDataFrame([("a", i, n, total) for i, n in enumerate(chars)], "track string, index long, chars long, total double")
    got = [r["duration"] for r in timeline.quota_durations(lines, c, "track").orderBy("index").collect()]
    assert got == pytest.approx(want) and sum(got) == pytest.approx(total)


def test_frames_sum_to_the_total(spark):
    rows = [("a", 0, 0.01, 2.0), ("a", 1, 0.02, 2.0), ("a", 2, 1.96, 2.0), ("b", 0, 1.0, 1.0), ("b", 1, 0.0, 1.0), ("c", 0, 0.5, 0.1), ("c", 1, 0.5, 0.1)]
    out = timeline.quantise_frames(spark.createDataFrame(rows, "track string, i long, d double, total double"), "track", "i", "d", 25, "total").collect()
    sums = {}
    for r in out:
        assert r["frames"] >= 1
        sums[r["track"]] = sums.get(r["track"], 0) + r["frames"]
    assert sums == {"a": 50, "b": 25, "c": 2}


def test_phrase_floor(spark):
    rows = [(1, i, n, 0.0, 2.4) for i, n in enumerate([10, 10, 1, 1, 1, 1])] + [(2, i, n, 1.0, 1.5) for i, n in enumerate([3, 1])]
    out = timeline.phrase_times(spark.createDataFrame(rows, "entry long, place int, chars long, start double, end double"), "entry", "place").orderBy("entry", "place").collect()
    first = [r for r in out if r["entry"] == 1]
    assert all(r["end"] - r["start"] >= 0.4 - 1e-9 for r in first) and first[-1]["end"] == 2.4
    assert all(a["end"] == b["start"] for a, b in zip(first, first[1:], strict=False))
    assert [round(r["end"] - r["start"], 6) for r in out if r["entry"] == 2] == [0.375, 0.125]


def test_merge_short_spans(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 6.0), ("a", 6.0, 7.0), ("a", 7.0, 12.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0)], "t string, start double, end double")
    assert sorted(map(tuple, timeline.merge_short(df, "t", 3.0).collect())) == [("a", 0.0, 7.0), ("a", 7.0, 12.0), ("b", 0.0, 2.0)]


def test_greedy_pick_budget_and_gaps(spark):
    rows = [(1, 0.0, 4.0, 9.0), (1, 1.0, 5.0, 8.0), (1, 10.0, 14.0, 7.0), (1, 20.0, 24.0, 6.0)]
    got = matching.greedy_pick(spark.createDataFrame(rows, "t long, start double, end double, score double"), "t", "score", 10.0, 2.0).orderBy("nth").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0.0, 4.0), (10.0, 14.0), (20.0, 22.0)]


def test_task_fingerprint_is_that_of_canonical_json(spark):
    """Python's own JSON of the same inputs, keys sorted."""
    import hashlib
    import json

    key = {"video": ("/v/é \"1\".mp4", 12, 1700000000), "text": "a\n\"b\" \\ü", "voice_id": "v", "speed": round(1.23456, 4), "pitch": 0, "style": "general", "keep_original_audio": False, "mirror": True, "zoom_percent": 130, "encoder_preference": "auto", "preset": "medium", "crf": 20, "schema": similar.TASK_SCHEMA}
    want = hashlib.sha1(json.dumps(key, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    lit = F.lit
    assert one(spark, similar.task_fingerprint(lit(key["video"][0]), lit(12), lit(1700000000), lit("  a\n\"b\" \\ü \t"), lit("v"), lit(1.23456))) == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, times.parse_timecode(lit("01:02:03,5"))) == 3723.5 and one(spark, times.parse_seconds(lit("bad"), 7.0)) == 7.0
    assert one(spark, times.srt_timestamp(lit(3723.4567))) == "01:02:03,457"
    with pytest.raises(Exception, match="no speed"):
        one(spark, times.strict_tempo_chain(lit(0.0)))
    assert one(spark, text.phrases(lit("你好，世界！今天。"))) == ["你好", "世界", "今天"]
    assert one(spark, text.preview(lit(" a\nb "))) == "a b" and one(spark, text.packed_lines(lit("aa\n bbb\n\ncc,dd,eeeeeeee"), 5)) == ["aa\nbbb", "cc,", "dd,", "eeeee", "eee"]
    assert one(spark, text.packed_lines(lit("aa\nbb"), 0)) == ["aa\nbb"] and one(spark, text.packed_lines(lit(" \n"), 5)) == []
    assert one(spark, text.word_positions(lit("aaa baab"), "aa")) == [0, 1, 5] and one(spark, text.word_positions(lit("xaax"), "aa")) == [1] and one(spark, text.word_positions(lit(""), "aa")) == []
    assert one(spark, times.tempo_chain(lit(1.0))) == [1.0] and one(spark, times.tempo_chain(lit(9.0))) == [2.0, 2.0] and one(spark, times.tempo_chain(lit(0.3))) == [0.5, 0.6]
    assert one(spark, times.strict_tempo_chain(lit(200.0))) == ["100.000000", "2.000000"] and one(spark, times.strict_tempo_chain(lit(0.25))) == ["0.500000", "0.500000"]
    assert one(spark, times.strict_tempo_chain(lit(1.0))) == [] and one(spark, times.strict_tempo_chain(lit(4.0))) == ["4.000000"] and one(spark, times.strict_tempo_chain(lit(0.1))) == ["0.500000", "0.500000", "0.500000", "0.800000"]
    assert [one(spark, normal.parse_int(lit(v))) for v in ("5.0", "1,200", "x", "5.5")] == [5, 1200, None, None]
    assert one(spark, similar.hex_words(lit("f" * 16 + "0" * 47 + "1"))) == [-1, 0, 0, 1]
    assert one(spark, similar.hash_similarity(F.array(*[lit(0)] * 4), F.array(lit(15), *[lit(0)] * 3))) == 1 - 4 / 256
    assert one(spark, similar.fingerprint_similarity(F.array(*map(lit, range(20))), F.array(*map(lit, range(2, 22))))) == 1.0
    assert one(spark, similar.envelope_similarity(F.array(lit(1.0), lit(1.0)), F.array(lit(2.0), lit(2.0)))) == 1.0
    assert sorted(["10仓库", "2街头", "01健身房"], key=lambda n: one(spark, text.natural_key(lit(n)))) == ["01健身房", "2街头", "10仓库"]
