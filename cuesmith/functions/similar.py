"""Similarity of hashes, fingerprints and envelopes, and its levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's inner functions use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words, over the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hash_similarity(a: Column, b: Column, words: int = 4) -> Column:
    """1 less the mean part of differing bits over paired frame hashes of `words`
    64-bit words each; 0 if either has none."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.greatest(F.lit(0.0), 1 - hamming(a, b) / (n / words * 64 * words))).otherwise(0.0)


def hex_words(value: Column) -> Column:
    """64 hex digits as four 64-bit words (conv alone would overflow)."""
    half = lambda i, k: F.conv(F.substr(value, i * 16 + 1 + k * 8, F.lit(8)), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 1)))


def average_hash(pixels: Column) -> Column:
    """Bits of the pixels that are at or over the mean, as an array of 0 and 1."""
    mean = lambda own: F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)
    return bound(pixels, lambda own: bound(mean(own), lambda m: F.transform(own, lambda p: F.when(p >= m, 1).otherwise(0))))


def packed_words(bits: Column) -> Column:
    """Bits (0 and 1, a multiple of 64) as 64-bit words, the first bit of a word its highest."""
    word = lambda own, k: F.aggregate(F.slice(own, k * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
    return bound(bits, lambda own: F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / 64).cast("int") - 1), lambda k: word(own, k)))


def fingerprint_similarity(a: Column, b: Column, reach: int = 3, least: int = 8) -> Column:
    """The best part of equal bits over shifts of up to `reach` words, with at least
    `least` 32-bit words in common; 0 where no shift has them."""

    def at(shift: Column) -> Column:
        x, y = F.slice(a, F.greatest(shift, F.lit(0)) + 1, F.size(a)), F.slice(b, F.greatest(-shift, F.lit(0)) + 1, F.size(b))
        n = F.least(F.size(x), F.size(y))
        bits = F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: F.bit_count(p.bitwiseXOR(q).bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, v: s + v)
        return F.when(n >= least, 1 - bits / (n * 32.0)).otherwise(0.0)

    return F.greatest(F.lit(0.0), F.array_max(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), at)))


def envelope_similarity(a: Column, b: Column) -> Column:
    """Mean-centred cosine mapped to [0, 1]; 1 where both are flat, 0 where one is."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    centred = lambda v: F.transform(v, lambda t: t - total(v) / n)
    dot = lambda p, q: total(F.zip_with(p, q, lambda s, t: s * t))
    norm_x, norm_y = F.sqrt(dot(centred(x), centred(x))), F.sqrt(dot(centred(y), centred(y)))
    flat = 1e-9
    cosine = (dot(centred(x), centred(y)) / (norm_x * norm_y) + 1) / 2
    return F.when(n <= 0, 0.0).when((norm_x < flat) & (norm_y < flat), 1.0).when((norm_x < flat) | (norm_y < flat), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def centred_envelope(v: Column) -> Column:
    """What each pair of an envelope needs of it: v, its mean-centred values and their norm."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + t)
    # The mean is bound by a transform of one element: inside the inner function it would be summed for each t.
    c = F.get(F.transform(F.array(total(v) / F.size(v)), lambda mean: F.transform(v, lambda t: t - mean)), 0)
    return F.struct(v.alias("v"), c.alias("c"), F.sqrt(total(F.transform(c, lambda t: t * t))).alias("norm"))


def centred_similarity(a: Column, b: Column) -> Column:
    """envelope_similarity of two centred envelopes; those of unlike lengths are centred anew."""
    flat = 1e-9
    dot = F.aggregate(F.zip_with(a["c"], b["c"], lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    cosine = (dot / (a["norm"] * b["norm"]) + 1) / 2
    same = F.when((a["norm"] < flat) & (b["norm"] < flat), 1.0).when((a["norm"] < flat) | (b["norm"] < flat), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))
    return F.when((F.size(a["v"]) == F.size(b["v"])) & (F.size(a["v"]) > 0), same).otherwise(envelope_similarity(a["v"], b["v"]))


def level(score: Column, threshold: float, floor: float = 0.78) -> Column:
    return F.when(score >= threshold, "high").when(score >= max(floor, threshold - 0.10), "medium").otherwise("low")


def audio_similarity(a: Column, b: Column) -> Column:
    """Of two structs (fingerprint, envelope, error): by fingerprints if both have
    one, else by envelopes; -1 where they can't be compared."""
    filled = lambda name: (F.size(F.coalesce(a[name], F.array())) > 0) & (F.size(F.coalesce(b[name], F.array())) > 0)
    failed = (F.coalesce(a["error"], F.lit("")) != "") | (F.coalesce(b["error"], F.lit("")) != "")
    return F.when(failed, -1.0).when(filled("fingerprint"), fingerprint_similarity(a["fingerprint"], b["fingerprint"])).when(filled("envelope"), envelope_similarity(a["envelope"], b["envelope"])).otherwise(-1.0)


# Names of a task's inputs in its canonical form, and that form's tag.
TASK_KEYS = ("crf", "encoder_preference", "keep_original_audio", "mirror", "pitch", "preset", "schema", "speed", "style", "text", "video", "voice_id", "zoom_percent")
TASK_SCHEMA = "bulk_dub@v2"


def _quoted(text: Column) -> Column:
    """A text as JSON: to_json of a list of it, without the brackets."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def task_fingerprint(path: Column, size: Column, modified: Column, text: Column, voice: Column, speed: Column, pitch: Column | None = None, style: Column | None = None, keep_audio: Column | None = None, mirror: Column | None = None, zoom: Column | None = None, encoder: Column | None = None, preset: Column | None = None, crf: Column | None = None) -> Column:
    """SHA-1 of a task's inputs as JSON, keys in order, with ", " and ": " between
    values: equal for equal inputs, whatever wrote them.  speed counts to four
    places, the text without blanks around it."""
    or_ = lambda c, v: F.lit(v) if c is None else c
    whole = lambda c: c.cast("long").cast("string")
    values = {
        "crf": whole(or_(crf, 20)), "encoder_preference": _quoted(or_(encoder, "auto")), "keep_original_audio": or_(keep_audio, False).cast("string"), "mirror": or_(mirror, True).cast("string"),
        "pitch": whole(or_(pitch, 0)), "preset": _quoted(or_(preset, "medium")), "schema": F.lit(f'"{TASK_SCHEMA}"'), "speed": F.bround(speed.cast("double"), 4).cast("string"), "style": _quoted(or_(style, "general")),
        "text": _quoted(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))), "video": F.concat(F.lit("["), _quoted(path), F.lit(", "), whole(size), F.lit(", "), whole(modified), F.lit("]")), "voice_id": _quoted(voice), "zoom_percent": whole(or_(zoom, 130)),
    }
    pairs = [F.concat(F.lit(f'"{k}": '), values[k]) for k in TASK_KEYS]
    return F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))


def machine_fingerprint(*parts: Column) -> Column:
    """The first 32 hex digits of SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
