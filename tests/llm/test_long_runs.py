"""Very long runs and paragraphs take time in proportion to their length."""

from __future__ import annotations

import re
import time

from cuesmith.llm import license_scan, quality

KIND = "doc_id long, text string, lang string, source string"


def seconds(f, *args) -> float:
    at = time.time()
    f(*args).collect()
    return time.time() - at


def test_a_million_blanks(spark):
    blanks = " " * 1_000_000
    df = spark.createDataFrame([(1, "a" + blanks + "b", "en", "s"), (2, blanks, "en", "s"), (3, "\t\n" * 500_000 + "x", "en", "s"), (4, "y" + blanks, "en", "s")], KIND)
    quality.quality_rules(df.limit(1)).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in quality.quality_rules(df).collect()} == {1: (2, 2), 2: (0, 0), 3: (1, 1), 4: (1, 1)}
    assert seconds(quality.quality_rules, df) < 5


def test_a_paragraph_of_100_000_words(spark):
    words = "the copy of this software was granted to any person without limitation and so it went on ".split()

    def made(n):
        text = " ".join(words[k % len(words)] + ("" if k % 7 else str(k)) for k in range(n))
        return spark.createDataFrame([(1, text + " Licensed under the Apache License, Version 2.0. " + text[:1000])], "doc_id long, text string")

    short, long = made(25_000), made(100_000)
    license_scan.scan_licenses(short).collect()
    assert [r["family"] for r in license_scan.scan_licenses(long).collect()] == ["Apache-2.0"]
    # Four times the words: twice as much again is left for a busy machine, and sixteen times would be a square.
    assert seconds(license_scan.scan_licenses, long) < 8 * max(0.25, min(seconds(license_scan.scan_licenses, short) for _ in range(3)))


def plain_scan(text: str) -> dict[int, tuple]:
    """Every line of the text, each part scored by plain sums."""
    import math

    m, out = license_scan.model(), {}
    families = m["families"]

    def verdict(part: int, words: list[str]) -> tuple:
        own = sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})
        z = list(m["bias"])
        if own:
            z = [(sum(m["weights"][g][i] for g in own if g in m["weights"]) / math.sqrt(len(own)) + m["bias"][i]) / m["heat"] for i in range(len(families))]
        best = z.index(max(z))
        p = 1 / sum(math.exp(v - z[best]) for v in z)
        similarity = len(set(own) & set(m["templates"][best])) / len(own) if own and best < len(families) - 1 else 0.0
        known = best < len(families) - 1 and p >= m["threshold"]
        return known and similarity >= license_scan.CONFIRM, part == 0, p, -part, families[best] if known else "unknown"

    for at, line in enumerate(text.split("\n")):
        words = re.findall(license_scan.WORD, line.lower())
        parts = [words]
        if len(words) > license_scan.LONG:
            parts += [words[k : k + license_scan.WINDOW] for k in range(0, len(words), license_scan.STRIDE)]
        best = max(verdict(k, w) for k, w in enumerate(parts))
        if best[-1] != "unknown":
            out[at] = best[-1], best[0]
    return out


def test_every_paragraph_is_judged(spark):
    """No list of anchors decides what is scored: known paragraphs are the plain model's over all lines."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + k, t) for k, t in enumerate(["to any person obtaining a copy\nof this software and associated documentation files", "mit dem Zug\nmit license", "A\n\nthe new work of the public", "You may obtain a copy of the License at\nin compliance with the License", "free and unencumbered software", "x " * 30 + "permission notice shall be included in all copies or substantial portions of it " + "y " * 30])]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()} | dict(extra)
    got: dict[int, dict] = {}
    for r in license_scan.scan_licenses(docs.unionByName(spark.createDataFrame(extra, docs.schema))).where("family <> 'unknown'").collect():
        got.setdefault(r["doc_id"], {})[r["line"]] = r["family"], r["confirmed"]
    assert got == {d: found for d, t in rows.items() if (found := plain_scan(t or ""))}
