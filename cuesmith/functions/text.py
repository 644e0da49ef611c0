"""Text functions: lexicon scores, positions, phrases, names, previews.

Word lists are parameters; a lexicon is a list of (category, word) in the order
that breaks ties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\v\f\r"
# Marks between phrases, and openings of a line that hold a viewer.
PHRASE_MARKS = "，,。．.！!？?；;：:、…\n"
CLAUSE_MARKS = "。！？!?；;，,、"
HOOKS = ("反转", "没想到", "居然", "秘密", "真相", "结果", "第一", "教你", "千万别", "警告")
DRAMA = ("反转", "高能", "秘密", "证据", "救命", "背叛", "复仇", "真相", "打脸", "崩溃", "冲突", "误会", "威胁", "求饶", "哭", "笑")


def _total(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def lexicon_scores(text: Column, lexicon: dict[str, list[str]], rules: list[tuple[str, str]] = ()) -> dict[str, Column]:
    """Each category's score: 1 for each of its words that the text holds, and 0.8
    for each of its patterns that the trimmed text matches.  A word of two
    categories counts for both."""
    out = {}
    for category in lexicon | {c: [] for _, c in rules}:
        parts = [F.when(F.contains(text, F.lit(w)), 1.0).otherwise(0.0) for w in lexicon.get(category, []) if w]
        parts += [F.when(F.trim(text).rlike(p), 0.8).otherwise(0.0) for p, c in rules if c == category]
        if parts:
            out[category] = _total(parts)
    return out


def best_category(scores: dict[str, Column], neutral: str = "neutral") -> tuple[Column, Column]:
    """(label, confidence): the first category with the best score, and its part of
    the sum; neutral and 0 where nothing counts."""
    names = F.array(*map(F.lit, scores))
    values = F.array(*scores.values())
    top, total = F.array_max(values), F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    label = F.get(names, F.array_position(values, top).cast("int") - 1)
    return F.when(top > 0, label).otherwise(neutral), F.when(top > 0, top / total).otherwise(0.0)


def word_positions(text: Column, word: str) -> Column:
    """All places (from 0) where the word starts, overlapping ones too.

    The text is parted before each of them by a lookahead; a place is the length
    of the parts before it, so work follows the text's length."""
    pattern = "(?=" + re.escape(word) + ")"
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))
    parts = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["found"], F.array(acc["at"])).alias("found"), (acc["at"] + F.length(x)).alias("at"))

    # The first part, even if empty, stands before the first place unless the text begins with the word.
    places = F.aggregate(parts, start, step, lambda a: a["found"])
    return F.when(F.startswith(text, F.lit(word)), F.filter(places, lambda i, k: (k == 0) | (i > 0))).otherwise(F.slice(places, 2, F.size(places)))


def lexicon_hits(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """array<struct<position, category, word>> by position, then the lexicon's order.
    Words that the text lacks cost one search each."""

    def hits(place: int, category: str, word: str) -> Column:
        each = F.transform(word_positions(text, word), lambda i: F.struct(i.alias("position"), F.lit(place).alias("ord"), F.lit(category).alias("category"), F.lit(word).alias("word")))
        return F.when(F.contains(text, F.lit(word)), each).otherwise(F.array().cast("array<struct<position:int,ord:int,category:string,word:string>>"))

    listed = [(c, w) for c, words in lexicon.items() for w in words]
    return F.array_sort(F.concat(*[hits(k, c, w) for k, (c, w) in enumerate(listed)]))


def hooks(line: Column, words: tuple[str, ...] = HOOKS) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(line, w))


def diagnose_opening(line: Column, seconds: Column, words: tuple[str, ...] = HOOKS) -> Column:
    """ok: a hook within 3 seconds; warn: only one of the two; risk: neither."""
    hook, quick = F.size(hooks(line, words)) > 0, seconds <= 3.0
    return F.when(hook & quick, "ok").when(hook | quick, "warn").otherwise("risk")


def strip_marks(text: Column) -> Column:
    """Without punctuation, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{P}+", ""), r"\s+", " "))


def phrases(line: Column, marks: str = PHRASE_MARKS) -> Column:
    """The line's phrases without marks; the whole line where that leaves none."""
    parts = F.filter(F.transform(F.split(line, "[" + re.escape(marks) + "]+", -1), strip_marks), lambda p: p != "")
    whole = F.filter(F.array(strip_marks(line)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def script_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def wrap(text: Column, width: int, most: int) -> Column:
    """Pieces of `width` characters; what is over `most` pieces becomes an ellipsis."""
    n = F.greatest(F.ceil(F.length(text) / width).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * width + 1, F.lit(width)))
    last = F.concat(F.slice(pieces, 1, most - 1), F.array(F.concat(F.substring(F.get(pieces, F.lit(most - 1)), 1, width - 1), F.lit("…"))))
    return F.when(n > most, last).otherwise(pieces)


# Fixed value: what a folder's name may start with before its own words.
NAME_LEAD = r"^[\d\s._\-—、·）)（(]+"


def clean_folder_name(name: Column) -> Column:
    """Without the number and marks that a name starts with."""
    return F.trim(F.regexp_replace(name, NAME_LEAD, ""))


def name_score(name: Column, line: Column) -> Column:
    """1 where the line holds the name; else 0.9 times the part of the name's
    distinct character pairs that the line holds."""
    n = clean_folder_name(name)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.substr(n, i, F.lit(2))))
    share = F.size(F.filter(grams, lambda g: F.contains(line, g))) / F.size(grams) * 0.9
    return F.when(n == "", 0.0).when(F.contains(line, n), 1.0).when(F.length(n) < 2, 0.0).otherwise(share)


def drama_score(text: Column, words: tuple[str, ...] = DRAMA, marks: str = "!！?？") -> Column:
    """7 for each word and 4 for each mark that the text holds, 35 at most."""
    parts = [F.when(F.contains(text, F.lit(w)), 7).otherwise(0) for w in words] + [F.when(F.contains(text, F.lit(m)), 4).otherwise(0) for m in marks]
    return F.least(F.lit(35), _total(parts))


def preview(text: Column, head: int = 24, tail: int = 6) -> Column:
    """Line feeds as blanks; more than head + tail + 1 characters lose their middle."""
    line = F.regexp_replace(F.trim(text), r"\r?\n", " ")
    return F.when(F.length(line) <= head + tail + 1, line).otherwise(F.concat(F.substring(line, 1, head), F.lit("…"), F.right(line, F.lit(tail))))


def natural_key(name: Column) -> Column:
    """Sorts by text, runs of digits by their number: a run is its length without
    leading zeros, in six digits, and then its digits, however many."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    sized = lambda p: F.concat(F.lpad(F.length(number(p)).cast("string"), 6, "0"), number(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), sized(p)).otherwise(p)), "")


def episode(name: Column, fallback: Column) -> Column:
    """The last three of all the name's digits as a number."""
    digits = F.regexp_replace(name, r"\D", "")
    return F.when(digits == "", fallback).otherwise(F.right(digits, F.lit(3)).cast("int"))


def infer_seconds(text: Column, default: float) -> Column:
    """The last-named of seconds, or minutes times 60; the default otherwise."""
    s, m = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:s|sec|seconds|秒)", 1), F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:min|minutes|分钟|分)", 1)
    return F.when(m != "", m.try_cast("double") * 60).when(s != "", s.try_cast("double")).otherwise(default)


def _packed(parts: Column, most: int, between: str) -> Column:
    """Parts joined while their own characters, without those between them, are at most `most`."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["n"] + F.length(x) > most)
        closed = F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], between)))).otherwise(acc["done"])
        held = F.when(full, F.array(x)).otherwise(F.concat(acc["open"], F.array(x)))
        return F.struct(closed.alias("done"), held.alias("open"), (F.when(full, 0).otherwise(acc["n"]) + F.length(x)).alias("n"))

    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.array_join(a["open"], between)))))


def _cut_long(line: Column, most: int) -> Column:
    """A long line's pieces: clauses that end with a mark, packed; a longer clause is cut anywhere."""
    clauses = F.filter(F.split(line, f"(?<=[{CLAUSE_MARKS}])", -1), lambda x: x != "")
    # Every full piece of `most` characters and the rest, by one pattern: places in a text are found in turn.
    return F.flatten(F.transform(_packed(clauses, most, ""), lambda p: F.regexp_extract_all(p, F.lit(f"(?s)(.{{1,{most}}})"), F.lit(1))))


def packed_lines(text: Column, most: int) -> Column:
    """A script's lines in chunks of at most `most` characters, line feeds between
    them not counted; lines over that are first cut at marks, then anywhere."""
    lines = script_lines(text)
    if most <= 0:
        return F.when(F.size(lines) > 0, F.array(F.array_join(lines, "\n"))).otherwise(lines)
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > most, _cut_long(x, most)).otherwise(F.array(x))))
    return _packed(parts, most, "\n")
