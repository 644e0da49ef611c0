"""Lexicons from tables against searching every word by itself."""

from __future__ import annotations

import json
import random
import re

from cuesmith.operators import lexicon


def places(text, words):
    return sorted((m.start(), o, c, w) for c, w, o in words for m in re.finditer(f"(?={re.escape(w)})", text or ""))


def test_all_overlapping_places_and_dealt_lexicons(spark):
    rng = random.Random(1)
    words = sorted({("ab"[k % 2], "".join(rng.choice("ano é") for _ in range(rng.randint(1, 5))), k % 40) for k in range(160)})
    once = {}
    for c, w, o in words:
        once[c, w] = min(o, once.get((c, w), o))
    words = [(c, w, o) for (c, w), o in once.items()]
    texts = [(i, "".join(rng.choice("ano é") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(40, None), (41, "")]
    df, lex = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([*words, ("a", "", 1), ("a", None, 1), words[0]], "category string, word string, ord long")
    for most in (lexicon.MOST_BYTES, 200):
        got = {r["id"]: [(h["position"], h["ord"], h["category"], h["word"]) for h in r["hits"]] for r in lexicon.with_hits(df, "text", lex, most_bytes=most).collect()}
        assert got == {i: places(t, words) for i, t in texts}
    none = lexicon.with_hits(df, "text", lex.limit(0)).collect()
    assert len(none) == 42 and all(r["hits"] == [] for r in none)


def test_labels_ties_rules_and_overrides(spark):
    lex = spark.createDataFrame([("calm", "sea", 1), ("calm", "sky", 2), ("tense", "run", 3), ("tense", "sea", 4)], "category string, word string, ord long")
    texts = spark.createDataFrame([(1, "sea"), (2, "run run!"), (3, "the sky and the sea"), (4, "nothing"), (5, "run?"), (6, " fixed "), (7, None), (8, "what?")], "id long, text string")
    fixed = spark.createDataFrame([("fixed", "tense")], "text string, category string")
    got = {r["id"]: (r["label"], r["confidence"], r["basis"]) for r in lexicon.labelled(texts, "text", lex, [(r"\?$", "ask", "question")], fixed).collect()}
    assert got == {1: ("calm", 0.5, "sea"), 2: ("tense", 1.0, "run"), 3: ("calm", 0.67, "sea、sky"), 4: ("neutral", 0.0, "none"), 5: ("tense", 0.56, "run"), 6: ("tense", 1.0, "override"), 7: ("neutral", 0.0, "none"), 8: ("ask", 1.0, "question")}


def test_first_hits_in_any_case(spark):
    terms = spark.createDataFrame([("Token", 2), ("ken", 1), ("PASS", 3)], "word string, ord long")
    texts = spark.createDataFrame([(1, "a ToKeN, a pass"), (2, "kEN"), (3, "no"), (4, None)], "id long, text string")
    got = {r["id"]: (r["at"], r["term"]) for r in lexicon.first_hits(texts, "text", terms).collect()}
    assert got == {1: (2, "token"), 2: (0, "ken")}


def test_a_users_file(spark, tmp_path):
    (tmp_path / "words.json").write_text(json.dumps({"calm": [" sea ", "", "sky", "sea"], "tense": ["run"], "odd": 3}))
    rows = {(r["category"], r["word"], r["ord"]) for r in lexicon.read_lexicon(spark, str(tmp_path / "words.json"), 10).collect()}
    assert rows == {("calm", "sea", 10), ("calm", "sky", 12), ("tense", "run", 10)}
