"""Lexicons from tables: all places of all words in one pass over the texts.

A lexicon is a table (category, word, ord).  Its words become an Aho-Corasick
automaton, which finds every place of every word, overlapping ones too, in time
that follows the text and not the lexicon.  Words are broadcast only up to
MOST_BYTES; a larger lexicon is dealt to as many automata as that takes, and the
texts pass one after the other, so neither the driver nor a task holds it whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similar import bound

#: Bytes of the words of one automaton, which takes about 20 times as many.
MOST_BYTES = 8 << 20
HIT_TYPE = "array<struct<position:int,ord:bigint,category:string,word:string>>"
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, rows: list[tuple[int, str | None, str]]) -> ahocorasick.Automaton:
    """The automaton of the words named by key, each with its length and its rows'
    places in the list; a Python worker keeps the last one."""
    if key not in _BUILT:
        _BUILT.clear()
        places: dict[str, list[int]] = {}
        for place, (_, _, word) in enumerate(rows):
            places.setdefault(word, []).append(place)
        made = ahocorasick.Automaton()
        for word, of in places.items():
            made.add_word(word, (len(word), of))
        made.make_automaton()
        _BUILT[key] = made
    return _BUILT[key]


def _every(made: ahocorasick.Automaton, text: str, longest: int) -> list[tuple[int, int]]:
    """(position, row) of every place of every word."""
    return sorted([(end - n + 1, place) for end, (n, of) in made.iter(text) for place in of])


def _once(made: ahocorasick.Automaton, text: str, longest: int) -> list[tuple[int, int]]:
    """The first place of every word that the text holds."""
    first: dict[int, int] = {}
    for end, (n, of) in made.iter(text):
        if of[0] not in first:
            for place in of:
                first[place] = end - n + 1
    return sorted((position, place) for place, position in first.items())


def _first(made: ahocorasick.Automaton, text: str, longest: int) -> list[tuple[int, int]]:
    """The first of all; a word that ends later may begin before it, if it is long enough."""
    best: tuple[int, int] | None = None
    for end, (n, of) in made.iter(text):
        if best is not None and end - longest + 1 > best[0]:
            break
        own = (end - n + 1, of[0])
        best = own if best is None else min(best, own)
    return [] if best is None else [best]


KEEP = {"all": _every, "once": _once, "first": _first}


def with_hits(texts: DataFrame, text: str, lexicon: DataFrame, name: str = "hits", most_bytes: int = MOST_BYTES, keep: str = "all") -> DataFrame:
    """texts with an array of (position, ord, category, word): every place (from 0,
    in characters) of every word, by position, then the lexicon's order.  keep:
    'once' gives each word's first place only, 'first' the first place of all.

    A word of several categories counts for each; of a row repeated in the lexicon
    the smallest ord counts.  Empty and null words and null texts give nothing.
    """
    spark = texts.sparkSession
    words = lexicon.where("word <> ''").groupBy("category", "word").agg(F.min("ord").cast("long").alias("ord"))
    size = words.agg(F.sum(F.octet_length("word") + F.octet_length(F.coalesce("category", F.lit(""))) + 8)).first()[0] or 0
    count = max(1, -(-size // most_bytes))
    out, names, find = texts, [f"_{name}{k}" for k in range(count)], KEEP[keep]
    for k, column in enumerate(names):
        part = words.where(F.pmod(F.xxhash64("word"), F.lit(count)) == k)
        rows = sorted(((r["ord"], r["category"], r["word"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
        sent = spark.sparkContext.broadcast(rows)
        at = out.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at, column=column, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            made, longest = _automaton(key, sent.value), max((len(w) for _, _, w in sent.value), default=0)
            of = [pa.array([r[i] for r in sent.value], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            for whole in batches:
                for top in range(0, whole.num_rows, 256):  # hits may be many more than the rows
                    batch = whole.slice(top, 256)
                    found = [find(made, t, longest) if t and len(made) else [] for t in batch.column(at).to_pylist()]
                    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                    flat = np.array([h for own in found for h in own], np.int64).reshape(-1, 2)
                    hits = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), *[c.take(pa.array(flat[:, 1])) for c in of]], ["position", "ord", "category", "word"])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, hits)], names=[*batch.schema.names, column])

        out = out.mapInArrow(run, out.withColumn(column, F.array().cast(HIT_TYPE)).schema)
    if count == 1:
        return out.withColumnRenamed(names[0], name)
    together = F.sort_array(F.concat(*names))
    return out.withColumn(name, F.slice(together, 1, 1) if keep == "first" else together).drop(*names)


def scored(hits: Column, text: Column, rules: list[tuple[str, str, str]] = ()) -> Column:
    """array<struct<score, hit, ord, category, basis>> by category, of hits that hold
    each word once: 1 for each word and 0.8 for each rule (pattern, category, label) that its
    trimmed form matches; basis: the words in the lexicon's order, then labels."""
    words = F.transform(hits, lambda h: F.struct(h["ord"].alias("ord"), h["category"].alias("category"), h["word"].alias("word")))
    trimmed = F.btrim(text, F.lit(" \t\n\v\f\r"))
    matched = [F.when(trimmed.rlike(p), F.array(F.struct(F.lit(2**62 + k).alias("ord"), F.lit(c).alias("category"), F.lit(label).alias("word")))) for k, (p, c, label) in enumerate(rules)]
    kind = "array<struct<ord:bigint,category:string,word:string>>"
    every = F.concat(words, *[F.coalesce(m, F.array().cast(kind)) for m in matched])

    def of(category: Column, rows: Column) -> Column:
        own = F.filter(rows, lambda h: h["category"] == category)
        score = F.aggregate(own, F.lit(0.0), lambda s, h: s + F.when(h["ord"] >= 2**62, 0.8).otherwise(1.0))
        return F.struct(score.alias("score"), (-F.get(own, F.lit(0))["ord"]).alias("first"), category.alias("category"), F.transform(own, lambda h: h["word"]).alias("basis"))

    return bound(F.sort_array(every), lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda h: h["category"])), lambda c: of(c, rows)))


def labelled(texts: DataFrame, text: str, lexicon: DataFrame, rules: list[tuple[str, str, str]] = (), overrides: DataFrame | None = None, neutral: str = "neutral", most: int = 4) -> DataFrame:
    """texts with label, confidence (two places) and basis.

    The label is the category with the best score, of equal ones the one whose
    first word stands first in the lexicon; a rule's counts after all words.
    overrides (text, category) fix a trimmed text's label, the last by category if
    there are several, with confidence 1 and the basis 'override'; texts that
    nothing hits are ``neutral``.
    """
    found = with_hits(texts, text, lexicon, "_hits", keep="once").withColumn("_scores", scored(F.col("_hits"), F.col(text), rules))
    best = F.array_max("_scores")
    total = F.aggregate("_scores", F.lit(0.0), lambda s, c: s + c["score"])
    some = F.size("_scores") > 0
    label, sure = F.when(some, best["category"]).otherwise(neutral), F.when(some, F.bround(best["score"] / total, 2)).otherwise(0.0)
    basis = F.when(some, F.array_join(F.slice(best["basis"], 1, most), "、")).otherwise("none")
    if overrides is None:
        return found.withColumns({"label": label, "confidence": sure, "basis": basis}).drop("_hits", "_scores")
    fixed = overrides.groupBy(F.btrim("text", F.lit(" \t\n\v\f\r")).alias("_text")).agg(F.max("category").alias("_fixed"))
    met = found.withColumn("_text", F.btrim(text, F.lit(" \t\n\v\f\r"))).join(fixed, "_text", "left")
    is_fixed = F.col("_fixed").isNotNull()
    return met.withColumns({"label": F.coalesce("_fixed", label), "confidence": F.when(is_fixed, 1.0).otherwise(sure), "basis": F.when(is_fixed, "override").otherwise(basis)}).drop("_hits", "_scores", "_text", "_fixed")


def first_hits(texts: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """texts that hold a term, with the first one's position (from 0) and itself, in
    any case of letters; of two at one place the first in the terms' order."""
    lowered = terms.select(F.lower("word").alias("word"), F.lit("").alias("category"), "ord")
    found = with_hits(texts.withColumn("_lower", F.lower(text)), "_lower", lowered, "_hits", keep="first")
    first = F.get("_hits", F.lit(0))
    return found.where(F.size("_hits") > 0).withColumns({"at": first["position"], "term": first["word"]}).drop("_hits", "_lower")


def read_lexicon(spark, path: str, ord_from: int = 0) -> DataFrame:
    """A user's words from JSON files {category: [word, ...]}: trimmed, blank ones
    left out; what is no list of texts is passed over.  ord follows the file."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.explode(F.from_json("value", "map<string, string>")).alias("category", "list"))
    words = parsed.select("category", F.posexplode(F.from_json("list", "array<string>")).alias("nth", "word"))
    words = words.select("category", F.btrim("word", F.lit(" \t\n\v\f\r")).alias("word"), "nth").where("word <> ''")
    return words.groupBy("category", "word").agg((F.min("nth") + ord_from).cast("long").alias("ord"))
