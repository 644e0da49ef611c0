"""Secret scan: candidate strings, and a random forest that drops false ones.

Candidates are long runs of key-like bytes, found by numpy on the text buffer, and
whatever a secret's name is given as its value, up to the next blank or quote.
The forest is trained from labelled findings (made from public formats by a seeded
generator) on a candidate's length, its character transitions, how much of it words
of a public vocabulary cover, the path that it was found under, and the words beside it.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, take_over
from .shingles import slices, text_buffer

MASK = "[SECRET]"
#: Bytes of a candidate; runs with a digit or one of =:, and those after a secret word, have candidates from LEAST on, others from LEAST_PLAIN on.
KEYLIKE = string.ascii_letters + string.digits + "+/_-.~=:$"
LEAST, LEAST_PLAIN = 8, 20
#: Lengths of dictionary words that are looked for in a candidate.
COVER = range(12, 3, -1)
BESIDE = 48
TREES, DEPTH, LEAF = 30, 9, 2
#: Bytes of text that are searched at a time, and of the rows that are taken together.
SLICE = PART = 1 << 21

# Words of dictionary coverage, and words near true and false findings.
WORDS = "the and for with that this from have will your you are not but all can was one out use new time page file path name user home data test example sample demo local host mail info config default value string number type class object index list map set get put post null true false none change changeme here insert replace placeholder dummy fake mock todo secret password token key api access auth login admin root public private client server service account database table column version release build commit branch master main image photo video audio chapter section article report order invoice product model phone street city country com org net www http https html php json xml csv txt pdf png jpg".split()
SECRET_WORDS = "password passwd pwd pass secret token apikey api_key key accesskey access_key auth authorization bearer credential credentials private aws".split()
FALSE_WORDS = "example sample dummy fake placeholder changeme uuid guid sha sha1 sha256 md5 hash checksum commit revision version isbn issn doi phone tel fax card order invoice ip address mail email url http https id serial model ref reference page build".split()
PATH_WORDS = "test tests example examples sample samples mock mocks fixture fixtures doc docs demo".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.", "npm_", "hf_")

_KEY = np.zeros(256, bool)
_KEY[list(KEYLIKE.encode())] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789=:")] = True
_SECRET = re.compile(r"(?<![a-z])(?:" + "|".join(SECRET_WORDS) + r")(?![a-z])")
_SECRET_BYTES = re.compile(_SECRET.pattern.encode())
#: A secret's name, and its value up to a blank, a quote or a bracket of a tag.
_ASSIGNED = re.compile(rb"(?i)(?<![a-z])(?:" + "|".join(SECRET_WORDS).encode() + rb")[\"'`]?[ \t]{0,4}(?:=>|:=|[=:])[ \t]{0,4}[\"'`]?([^\s\"'`<>]+)")
_MARKED = re.compile(rb"[=:]")
#: A run is parted at each = and :, but = at the end of a part is its padding.
_PART = re.compile(r"[^=:]+(?:=+(?=:|\Z))?")
_FALSE = re.compile(r"(?<![a-z])(?:" + "|".join(FALSE_WORDS) + r")(?![a-z])")
_PATH = re.compile(r"(?<![a-z])(?:" + "|".join(PATH_WORDS) + r")(?![a-z])")
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_CLASS = np.zeros(256, np.int64)
_CLASS[list(string.ascii_lowercase.encode())] = 1
_CLASS[list(string.ascii_uppercase.encode())] = 2
_CLASS[list(string.digits.encode())] = 3


@lru_cache(1)
def dictionary(path: str | None = None) -> frozenset[str]:
    """Whole words of a public vocabulary file, and WORDS."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return frozenset([*WORDS, *(w for t in tokens if t.endswith("</w>") and (w := t[:-4]).isascii() and w.isalpha() and len(w) in COVER)])


def _covered(low: str) -> int:
    """Characters within dictionary words, the longest from each place on."""
    words, at, total = dictionary(), 0, 0
    while at < len(low):
        n = next((k for k in COVER if low[at : at + k] in words and at + k <= len(low)), 0) if low[at].isalpha() else 0
        total += n
        at += n or 1
    return total


def describe(value: str, before: str, after: str, path: str) -> list[float]:
    """The features of one candidate."""
    raw = np.frombuffer(value.encode(), np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    share = counts[counts > 0] / n
    kinds = _CLASS[raw]
    pairs = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) / max(1, n - 1)
    low = value.lower()
    covered = _covered(low) / n
    before, after = before.lower(), after.lower()
    return [
        float(min(n, 512)), float(-(share * np.log2(share)).sum()), *pairs.tolist(), len(share) / n, covered,
        float(bool(_HEX.match(value))), float(value.isdigit()), float(value.startswith(PREFIXES)), float(value.count(".")), float(value.count("-")), float(value.count("/")),
        float(bool(_SECRET.search(before))), float(bool(_FALSE.search(before) or _FALSE.search(after))), float(before.rstrip(" \"'").endswith(("=", ":"))), float(bool(_PATH.search(path.lower()))),
    ]


def labelled_findings(each: int = 40, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, text before, text after, path, 1 for a secret or else 0)."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    word = lambda: r.choice(WORDS)
    syllables = ["th", "on", "er", "re", "an", "in", "ti", "es", "or", "te", "ou", "en", "sch", "ung", "eau", "ción", "la", "de"]
    prose = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(5))
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    keyed = lambda: prose() + " " + r.choice(["", "", "db_", "aws_", "MY_", "client-"]) + r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "PASSWORD", "Token", "pwd", "secret_key"]) + r.choice(["=", ": ", ' = "', "='", " = ", ":", '="', '": "'])
    plain = lambda: prose() + " "
    near = lambda: prose() + " " + r.choice(FALSE_WORDS) + r.choice([" ", ": ", "=", " = "])
    paths = lambda: r.choice(["", "web/crawl", "app/config", "deploy/prod.env", "forum", "notes", "repo/main"])
    leet = lambda w: "".join({"a": "4", "e": "3", "o": "0", "i": "1", "s": "$"}.get(c, c) if r.random() < 0.6 else c for c in w)
    coined = lambda n: "".join(r.choice(syllables[:13]) for _ in range(n))
    out: list[tuple[str, str, str, str, int]] = []
    for _ in range(each):
        yes = [
            (r.choice(["AKIA", "ASIA"]) + pick(upper[:26] + "234567", 16), r.choice([plain, plain, keyed])()), ("AKIA" + pick(upper, 16), plain()), ("AKIA" + pick(string.ascii_uppercase, 16), plain()), (r.choice(["ghp_", "gho_"]) + pick(mixed, 36), r.choice([plain, keyed])()), ("sk_live_" + pick(mixed, 24), r.choice([plain, keyed])()),
            (pick(hexes, r.randint(12, 31)), keyed()), (pick(hexes, r.randint(32, 64)), keyed()), (pick(mixed, r.randint(10, 40)), keyed()), (pick(mixed + "+/", r.choice([32, 40, 64])), keyed()), ("AIza" + pick(mixed + "_-", 35), plain()),
            ("eyJ" + pick(mixed, 30) + "." + pick(mixed, 60) + "." + pick(mixed, 43), plain()), ("xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24), r.choice([plain, keyed])()), (r.choice(["glpat-", "npm_", "hf_"]) + pick(mixed, r.randint(20, 36)), r.choice([plain, keyed])()),
            (leet(coined(3)).capitalize() + r.choice("!@#$%&*-_") + pick(string.digits, r.randint(1, 4)) + r.choice(["", "!", "x", "!z"]), keyed()), (pick(mixed + "!@#$%^&*()-_=+", r.randint(8, 24)), keyed()), (pick(mixed, r.randint(6, 9)) + r.choice(string.digits), keyed()), (leet(word()) + pick(string.digits, r.randint(2, 4)) + r.choice("!@#$%&*"), keyed()),
        ]
        no = [
            (pick(hexes, 40), near()), (pick(hexes, r.choice([32, 64])), near()), (pick(hexes, 40), plain()), ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), plain()), (".".join(str(r.randint(0, 255)) for _ in range(4)), plain()), (pick(string.digits, r.choice([8, 10, 12, 13, 16, 19])), plain()), (pick(string.digits, 16), near()),
            (f"{word()}.{r.randint(1, 99)}", plain()), (f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-rc{r.randint(1, 9)}", plain()), (f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", plain()), (f"{word()}_{word()}_{word()}_{r.randint(1, 99)}", plain()), ("/".join(word() for _ in range(4)) + f"/{r.randint(1, 999)}", plain()),
            (f"{word()}_{word()}_here", keyed()), (r.choice(["changeme", "password", "example", "yourpassword", "dummytoken", "secret"]) + r.choice(["", "_here", "-here"]), keyed()), (r.choice("x*.") * r.randint(3, 40), keyed()), (r.choice(string.ascii_letters + "0") * r.randint(8, 32), keyed()), (prose().replace(" ", "").encode("ascii", "ignore").decode()[:40].ljust(20, "e"), plain()), (f"{word()}:{word()}{r.randint(1, 9)}", plain()), (f"{word()}-{word()}-{word()}-{r.randint(1, 9999)}", plain()), (f"{word()}={r.randint(10, 99999999)}", plain()), (f"{r.randint(1, 12)}:{r.randint(10, 59)}:{r.randint(10, 59)}", plain()), (f"+{r.randint(1, 99)}-{pick(string.digits, 3)}-{pick(string.digits, 7)}", plain()), (f"www.{word()}{r.randint(1, 9)}.com/{word()}", plain()),
            (r.choice(["required", "optional", "hidden", "invalid", "expired", "string", "none", "null", "undefined", "mandatory", "forgotten", "needed", "missing", "wrong", "the", "your", "please", "must", "enter"]), keyed()), (coined(r.randint(1, 4)), keyed()), (r.choice(["${{{}}}", "${}", "%{}%", "{{{{{}}}}}", "os.environ[{}]", "process.env.{}", "get_{}()", "<{}>", "self.{}", "config.{}"]).format(word().upper() if r.random() < 0.5 else word()), keyed()), (f"{word()}.{word()}.{word()}", keyed()), (str(r.randint(0, 9999)), keyed()),
        ]
        out += [(v, b, " " + prose(), paths(), 1) for v, b in yes] + [(v, b, " " + prose(), paths(), 0) for v, b in no]
        out.append((pick(mixed, r.randint(16, 40)), keyed(), " " + prose(), r.choice(PATH_WORDS) + "/" + word(), 0))
    return out


class Forest:
    """Trees grown on bootstrap rows, each split on the best of a few drawn features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            rows = rng.integers(0, len(x), len(x))
            tree: list[tuple] = []
            self._grow(tree, x[rows], y[rows], 0, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*tree, strict=True)))

    def _grow(self, tree: list[tuple], x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(tree)
        tree.append((-1, 0.0, -1, -1, float(y.mean())))
        if depth == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
            return at
        best = (2.0, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1]) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= LEAF) & (k <= len(y) - LEAF)]
            if not len(k):
                continue
            left, right = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
            impurity = (k * left * (1 - left) + (len(y) - k) * right * (1 - right)) / len(y)
            i = int(impurity.argmin())
            best = min(best, (float(impurity[i]), int(f), float(v[k[i] - 1] + v[k[i]]) / 2))
        if best[1] < 0:
            return at
        goes = x[:, best[1]] <= best[2]
        left = self._grow(tree, x[goes], y[goes], depth + 1, rng)
        right = self._grow(tree, x[~goes], y[~goes], depth + 1, rng)
        tree[at] = (best[1], best[2], left, right, float(y.mean()))
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)


@lru_cache(1)
def forest() -> Forest:
    found = labelled_findings()
    return Forest(np.array([describe(*f[:4]) for f in found]), np.array([f[4] for f in found]))


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of each run of key-like bytes that is long enough."""
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(last, at + SLICE)
        while to < last and _KEY[data[to - 1]] and _KEY[data[to]]:
            to += 1
        key = np.zeros(to - at + 2, np.int8)
        key[1:-1] = _KEY[data[at:to]]
        inner = offsets[(offsets > at) & (offsets < to)] - at
        edges = np.diff(key)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if len(inner):  # a run doesn't reach over two rows
            cuts = inner[(key[inner] == 1) & (key[inner + 1] == 1)]
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        marks = np.concatenate(([0], np.cumsum(_MARK[data[at:to]])))
        kept = (marks[ends] > marks[starts]) | (ends - starts >= LEAST_PLAIN)
        starts, ends = starts + at, ends + at
        rows = np.searchsorted(offsets, starts, "right") - 1
        plain = np.flatnonzero(~kept)
        lead = max(int(offsets[0]), at - BESIDE)
        lower = data[lead:to].tobytes().lower() if len(plain) else b""
        least = np.maximum(offsets[rows], starts - BESIDE) - lead
        for i in plain.tolist():
            kept[i] = _SECRET_BYTES.search(lower[int(least[i]) : int(starts[i]) - lead]) is not None
        yield from zip(rows[kept].tolist(), starts[kept].tolist(), ends[kept].tolist(), strict=True)
        at = to


def _is_apart(value: bytes) -> bool:
    """Whether parts of key-like runs would miss some of an assigned value."""
    return bool(value) and (any(not _KEY[b] for b in value) or len(value) < LEAST and not _MARKED.search(value))


def _near(spans: list[tuple[int, int]], place: int) -> int:
    """Where the spans that may reach over place begin: they are in order and apart."""
    return max(0, bisect(spans, (place, 1 << 62)) - 1)


def find(texts: pa.Array, paths: list[str | None]) -> list[tuple[int, int, int, str, float]]:
    """(row, start, length, value, score) of all candidates; start in code points."""
    data, offsets = text_buffer(texts)
    spans: dict[int, list[tuple[int, int]]] = {}
    for row in range(len(texts)):
        first, last = int(offsets[row]), int(offsets[row + 1])
        for m in _ASSIGNED.finditer(data[first:last].tobytes()):
            value = m.group(1).rstrip(b".,;:)]}")
            if _is_apart(value):
                spans.setdefault(row, []).append((first + m.start(1), first + m.start(1) + len(value)))
    for row, start, end in _runs(data, offsets):
        own = spans.get(row, [])
        for part in _PART.finditer(data[start:end].tobytes().decode()):
            value = part.group().rstrip(".")
            place = start + part.start()
            if len(value) >= LEAST and not any(s < place + len(value) and place < e for s, e in own[_near(own, place) :][:2]):
                spans.setdefault(-1 - row, []).append((place, place + len(value)))
    found, features = [], []
    for row in sorted({r if r >= 0 else -1 - r for r in spans}):
        first, last = int(offsets[row]), int(offsets[row + 1])
        for place, end in sorted(spans.get(row, []) + spans.get(-1 - row, [])):
            value = data[place:end].tobytes().decode()
            before = data[max(first, place - BESIDE) : place].tobytes().decode(errors="ignore")
            after = data[end : min(last, end + BESIDE)].tobytes().decode(errors="ignore")
            found.append((row, place, len(value), value))
            features.append(describe(value, before, after, paths[row] or ""))
    if not found:
        return []
    out, seen = [], (-1, 0, 0)  # row, bytes and code points so far
    for (row, place, n, value), score in zip(found, forest().score(np.array(features)).tolist(), strict=True):
        if row != seen[0]:
            seen = (row, int(offsets[row]), 0)
        seen = (row, place, seen[2] + int(((data[seen[1] : place] & 0xC0) != 0x80).sum()))
        out.append((row, seen[2], n, value, score))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, length, value, score, secret): each candidate of each row,
    with the forest's score; secret at 0.5 or more.

    start and length are in code points of the whole text.  A null or empty text
    has no candidates; a null path counts as empty; repeated rows repeat their
    findings; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("secrets")
        for batch in batches:
            for rows in slices(batch, 1, PART):
                ids = rows.column(0).to_pylist()
                out = [(ids[r], s, n, v, p, p >= 0.5) for r, s, n, v, p in find(rows.column(1), rows.column(2).to_pylist())]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["doc_id", "start", "length", "value", "score", "secret"])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), path).mapInArrow(run, "doc_id long, start long, length long, value string, score double, secret boolean")


def redact_secrets(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with each secret in the text replaced by MASK; all columns stay.

    Null and empty texts stay as they are; a null path counts as empty; repeated
    rows are masked alike; an empty table stays empty.  Columns of any other names
    pass by unread.
    """

    places = docs.columns.index(text_col), docs.columns.index(path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("secrets")
        for rows in (x for batch in batches for x in slices(batch, places[0], PART)):
            texts, paths = (rows.column(p).cast(pa.string()) for p in places)
            values, spans = texts.to_pylist(), {}
            for row, start, n, _, score in find(texts, paths.to_pylist()):
                if score >= 0.5:
                    spans.setdefault(row, []).append((start, n))
            for row, own in spans.items():
                value, pieces, at = values[row], [], 0
                for start, n in own:
                    pieces += [value[at:start], MASK]
                    at = start + n
                values[row] = "".join(pieces) + value[at:]
            yield rows.set_column(places[0], rows.schema.field(places[0]), pa.array(values, pa.string()).cast(rows.schema.field(places[0]).type))
        give_back()

    return docs.mapInArrow(run, docs.schema)
