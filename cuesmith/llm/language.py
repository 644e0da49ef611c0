"""Language identification by a byte convolutional network in numpy.

Bytes are folded to at most CLASSES classes (the commonest bytes of the training
text, A-Z as a-z; the rest share one).  Filters of widths 2, 3 and 4 run over
fixed windows of WINDOW bytes; each filter's maximum in the window goes through a
rectifier to a softmax over the languages seen.  A text is all its windows in
turn: their probabilities are averaged by their numbers of bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, take_over
from .shingles import slices, text_buffer

CLASSES, EMBED, FILTERS, WINDOW = 48, 12, 12, 256
WIDTHS = (2, 3, 4)
LOOK = max(WIDTHS) - 1
#: The model is fitted on about so many labelled texts of each language, and a passage of so many characters of each, from a place that its id's hash chooses; predictions read whole texts.
SAMPLE_TEXTS, SAMPLE_CHARS = 600, 1024
#: Bytes that a task convolves at a time, and of the texts whose windows it lays out at a time.
SLICE, PART = 1 << 16, 1 << 20


class ByteNet:
    def __init__(self, fold: np.ndarray, languages: list[str], embed: np.ndarray, filters: list[np.ndarray], shift: np.ndarray, dense: np.ndarray, bias: np.ndarray):
        self.fold, self.languages, self.embed, self.filters = fold, languages, embed, filters
        self.shift, self.dense, self.bias = shift, dense, bias
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of classes adds to the filters: as a window's first two
        bytes, and as its third and fourth (to the wider filters only)."""
        if self.tables is None:
            n = len(self.embed)
            taps = [[self.embed @ f[k] for k in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
            first = np.concatenate([(t[0][:, None, :] + t[1][None, :, :]).reshape(n * n, -1) for t in taps], 1)
            third = np.broadcast_to(taps[1][2][:, None, :], (n, n, FILTERS)).reshape(n * n, -1)
            fourth = (taps[2][2][:, None, :] + taps[2][3][None, :, :]).reshape(n * n, -1)
            self.tables = first.astype(np.float32), np.concatenate([third, fourth], 1).astype(np.float32)
        return self.tables

    def filtered(self, classes: np.ndarray) -> np.ndarray:
        """Filter outputs at the WINDOW places of each row, which has LOOK more."""
        first, then = self.pair_tables()
        pairs = classes[:, :-1].astype(np.int32) * len(self.embed) + classes[:, 1:]
        out = np.take(first, pairs[:, :-2], axis=0)
        out[:, :, FILTERS:] += np.take(then, pairs[:, 2:], axis=0)
        return out

    def probabilities(self, classes: np.ndarray) -> np.ndarray:
        scores = np.maximum(self.filtered(classes).max(1) + self.shift, 0) @ self.dense + self.bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def texts(self, column: pa.Array) -> np.ndarray:
        """Class probabilities of each row."""
        data, offsets = text_buffer(column)
        sizes = np.diff(offsets)
        counts = np.maximum(1, -(-sizes // WINDOW))
        total = np.zeros((len(sizes), len(self.languages)))
        rows = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = offsets[rows] + nth * WINDOW
        stop = offsets[rows + 1]
        step = SLICE // WINDOW
        reach = np.arange(WINDOW + LOOK)
        for at in range(0, len(rows), step):
            s, e = start[at : at + step], stop[at : at + step]
            place = s[:, None] + reach[None, :]
            inside = place < e[:, None]
            own = np.where(inside, self.fold[data[np.minimum(place, max(0, len(data) - 1))]] if len(data) else 0, 0)
            share = np.maximum(1, np.minimum(WINDOW, e - s))
            np.add.at(total, rows[at : at + step], self.probabilities(own) * share[:, None])
        return total / total.sum(1, keepdims=True)


def _fold(texts: list[bytes]) -> np.ndarray:
    lower = np.arange(256)
    lower[65:91] += 32
    counts = np.bincount(lower[np.frombuffer(b"".join(texts), np.uint8)], minlength=256)
    best = [b for b in np.argsort(-counts, kind="stable")[: CLASSES - 2] if counts[b]]
    fold = np.ones(256, np.uint8)  # 0: past the end, 1: any other byte
    for i, b in enumerate(best):
        fold[b] = i + 2
    return fold[lower]


def train(texts: list[str], labels: list[str], epochs: int = 12, seed: int = 7) -> ByteNet:
    """Fit on windows of the texts by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    raw = [t.encode() for t in texts]
    fold = _fold(raw)
    x, y = [], []
    for t, label in zip(raw, labels, strict=True):
        folded = fold[np.frombuffer(t, np.uint8)]
        for k in range(0, max(1, len(folded)), WINDOW):
            own = folded[k : k + WINDOW + LOOK]
            # Some windows end early, as a short text's would.
            own = own[: int(rng.integers(12, WINDOW))] if rng.random() < 0.3 else own
            x.append(np.pad(own, (0, WINDOW + LOOK - len(own))))
            y.append(languages.index(label))
    x, y = np.array(x, np.uint8), np.array(y)
    n, f = len(languages), len(WIDTHS) * FILTERS
    net = ByteNet(fold, languages, rng.normal(0, 0.3, (CLASSES, EMBED)), [rng.normal(0, 0.3, (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(f), rng.normal(0, 0.3, (f, n)), np.zeros(n))
    values = [net.embed, *net.filters, net.shift, net.dense, net.bias]
    means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    weight = len(y) / (n * np.bincount(y, minlength=n))  # languages count alike
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            own, want = x[at], y[at]
            net.tables = None
            out = net.filtered(own)
            top = out.argmax(1)
            hidden = np.take_along_axis(out, top[:, None, :], 1)[:, 0, :] + net.shift
            live = np.maximum(hidden, 0)
            p = live @ net.dense + net.bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(want)), want] -= 1
            p *= weight[want][:, None] / len(want)
            back = (p @ net.dense.T) * (hidden > 0)
            slope = [np.zeros_like(net.embed), *[np.zeros_like(v) for v in net.filters], back.sum(0), live.T @ p, p.sum(0)]
            for i, w in enumerate(WIDTHS):
                g, t = back[:, i * FILTERS : (i + 1) * FILTERS], top[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    by_class = np.zeros((CLASSES, FILTERS))
                    np.add.at(by_class, (own[np.arange(len(own))[:, None], t + k], np.arange(FILTERS)[None, :]), g)
                    slope[0] += by_class @ net.filters[i][k].T
                    slope[1 + i][k] += net.embed.T @ by_class
            step += 1
            for v, d, m, s in zip(values, slope, means, squares, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.tables = None
    return net


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A net from a bounded, hash-chosen sample of the rows that are not held out
    (about SAMPLE_TEXTS of each language, equal passages once; all languages are
    learned); None if no row has a language and text."""
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null and t <> ''")
    counts = rows.groupBy("l").count().collect()  # a row for each language
    if not counts:
        return None
    shares = F.from_json(F.lit(json.dumps({r["l"]: min(1.0, SAMPLE_TEXTS / r["count"]) for r in counts})), "map<string, double>")
    place = F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(F.lit(1), F.length("t") - SAMPLE_CHARS + 1)).cast("int") + 1
    drawn = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)) < F.element_at(shares, F.col("l")) * (1 << 20)).select("i", F.substring(F.col("t"), place, F.lit(SAMPLE_CHARS)).alias("t"), "l")
    sample = sorted(drawn.distinct().collect(), key=lambda r: (r["i"] is None, r["i"] or 0, r["t"], r["l"]))
    return train([r["t"] for r in sample], [r["l"] for r in sample]) if sample else None


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _guesses(model: ByteNet | None, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The likeliest language of each text and its probability; null and 0 without a net."""
    if model is None or not len(texts):
        return [None] * len(texts), np.zeros(len(texts))
    p = model.texts(texts)
    return [model.languages[i] for i in p.argmax(1)], p.max(1)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    ``und`` with score 0 for a null text or one without a letter, and for every
    row if there is no net; null ids are not held out.  Repeated rows get the
    same; an empty table gives an empty result; other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(net)  # some 20 kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        for rows in (x for batch in batches for x in slices(batch, 1, PART)):
            langs, scores = _guesses(spread.value, rows.column(1))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "letter", "l", "s"])
        give_back()

    text = F.col(text_col).cast("string")
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.coalesce(held_out(id_col), F.lit(False)), has_letter(text))
    seen = seen.mapInArrow(run, "doc_id long, held_out boolean, letter boolean, l string, s double")
    sure = F.col("letter") & F.col("l").isNotNull()
    return seen.select("doc_id", "held_out", F.when(sure, F.col("l")).otherwise("und").alias("lang_pred"), F.when(sure, F.col("s")).otherwise(0.0).alias("score"))


def keep_identified(docs: DataFrame, net: ByteNet | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose language is one of the net's
    with a score of least or more; decided within the row, so nothing is shuffled.
    Null texts, texts without a letter and, without a net, all rows go; repeated
    rows are judged alike; an empty table stays empty."""
    spread = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        for rows in (x for batch in batches for x in slices(batch, place, PART)):
            yield rows.filter(pa.array(_guesses(spread.value, rows.column(place))[1] >= least))
        give_back()

    return docs.where(has_letter(F.col(text_col))).mapInArrow(run, docs.schema)
