"""Notices in any case of letters, in wrapped lines and inside long lines."""

from __future__ import annotations

from cuesmith.llm.license_scan import scan_licenses

FILLER = "the river runs past the old mill and the children walk home along its bank in the evening "


def test_notices_in_every_spelling(spark):
    rows = ["Published under Creative Commons Attribution 4.0", "released under gplv3", "cc by 4.0", "cc0 1.0", "mpl-2.0", "Dedicated to the Public Domain"]
    got = {r["doc_id"]: r["family"] for r in scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert set(got) == set(range(len(rows)))
    assert {k: got[k] for k in range(2, 5)} == {2: "CC-BY", 3: "CC0", 4: "MPL-2.0"} and got[0].startswith("CC-BY")


def test_notice_inside_a_long_line(spark):
    rows = [(1, FILLER * 20 + "Licensed under the Apache License, Version 2.0. " + FILLER * 20), (2, FILLER * 20 + "He lost his license. " + FILLER * 20), (3, FILLER * 40)]
    got = [(r["doc_id"], r["line"], r["family"], r["confirmed"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got)[0] == (1, 0, "Apache-2.0", True) and [(d, c) for d, _, _, c in sorted(got)[1:]] == [(2, False)]


def test_wrapped_lines_without_an_anchor(spark):
    text = "Permission is hereby granted, free of charge, to any person\nto deal in the Software without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute\nand a line of other words"
    got = {r["line"]: (r["family"], r["confirmed"]) for r in scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(3), ("MIT", True))
