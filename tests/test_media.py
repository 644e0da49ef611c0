"""Sound by byte ranges and image hashes against plain computations, and broken files."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest

from cuesmith.plans.media_queries import bitmap
from cuesmith.sources import pictures, sound


def samples(n, channels=1, seed=1):
    rng = random.Random(seed)
    return [rng.choice([0, 0, rng.randint(-32768, 32767)]) for _ in range(n * channels)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sounds")
    made = {"mono": (samples(1001), 100, 1), "stereo": (samples(333, 2), 50, 2), "short": (samples(5), 8, 1), "zeros": ([0] * 300, 100, 1), "none": ([], 8, 1)}
    for name, (x, rate, channels) in made.items():
        (at / f"{name}.wav").write_bytes(sound.wav_bytes(np.array(x), rate, channels))
    body = sound.wav_bytes(np.array(samples(40, seed=2)), 20)
    (at / "list.wav").write_bytes(body[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + body[12:-20])  # another chunk first, and a length beyond the end
    made["list"] = (samples(40, seed=2)[:30], 20, 1)
    (at / "text.wav").write_text("no sound at all")
    (at / "cut.wav").write_bytes(body[:20])
    (at / "other.txt").write_text("x")
    return str(at), {k: (np.array(x, float).reshape(-1, c).mean(1), rate) for k, (x, rate, c) in made.items()}


@pytest.mark.parametrize("range_bytes", [14, 1000, 1 << 20])
def test_loudness_and_envelopes(spark, folder, range_bytes):
    at, made = folder
    name = lambda r: r["path"].rsplit("/", 1)[-1][:-4]
    levels: dict = {}
    for r in sound.loudness(spark, at, 0.25, range_bytes).collect():
        levels.setdefault(name(r), {})[r["at"]] = r["db"]
    for k, (x, rate) in made.items():
        width = max(1, int(rate * 0.25))
        want = {s / rate: 20 * math.log10(math.sqrt((x[s : s + width] ** 2).mean()) / 32768) if (x[s : s + width] ** 2).mean() > 0 else -96.0 for s in range(0, len(x), width)}
        assert levels.get(k, {}) == {s: pytest.approx(v) for s, v in want.items()}
    got = {name(r): (r["seconds"], r["envelope"]) for r in sound.envelopes(spark, at, 32, range_bytes).collect()}
    assert set(got) == set(made)
    for k, (x, rate) in made.items():
        width = max(1, len(x) // 32)
        rms = [math.sqrt((x[i * width : (i + 1) * width] ** 2).mean()) if len(x[i * width : (i + 1) * width]) else 0.0 for i in range(32)]
        want = [round(v / max(rms), 6) if max(rms) > 0 else 0.0 for v in rms] if len(x) else []
        assert got[k] == (pytest.approx(len(x) / rate), pytest.approx(want, abs=1.1e-6))
    assert {name(r) for r in sound.faults(spark, at).collect()} == {"text", "cut"}


def test_image_hashes(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"a": rng.integers(0, 256, (32, 32)), "b": rng.integers(0, 256, (24, 20)), "c": np.full((16, 16), 7)}
    for k, rows in made.items():
        (tmp_path / f"{k}.bmp").write_bytes(bitmap(rows))
    (tmp_path / "broken.bmp").write_bytes(b"BM no image")
    got = {r["path"].rsplit("/", 1)[-1][:-4]: r["words"] for r in pictures.image_hashes(spark, str(tmp_path)).collect()}
    assert got["broken"] is None and got["c"] == [-1, -1, -1, -1]
    for k in "ab":
        h, w = made[k].shape
        # Each pixel as a square of 16 x 16 small ones, of which the cells take whole ones.
        fine = np.kron(made[k], np.ones((16, 16)))
        cells = fine.reshape(16, h, 16, w).mean((1, 3))
        bits = "".join("1" if c >= cells.mean() - 1e-9 else "0" for c in cells.ravel())
        words = [int(bits[i : i + 64], 2) for i in range(0, 256, 64)]
        assert got[k] == [v - 2**64 if v >= 2**63 else v for v in words]
    bgr = np.array([[[10, 20, 30, 255]]], np.uint8)
    assert pictures.grey(bgr.tobytes(), 1, 1, 4)[0, 0] == (30 * 299 + 20 * 587 + 10 * 114) / 1000
