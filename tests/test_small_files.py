"""Many small files are few tasks' work, and few input rows that become files are many tasks'."""

from __future__ import annotations

import numpy as np

from cuesmith.catalog import queries
from cuesmith.sources import sound

from .compare import SF_DIR


def test_small_recordings_share_a_task(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.wav").write_bytes(sound.wav_bytes(np.full(60, k), 8))
    (tmp_path / "bad.wav").write_bytes(b"none")
    reader = sound._WavReader({"path": str(tmp_path), "seconds": "0.25", "rangebytes": "50"})
    packs = reader.partitions()
    assert len(packs) < 10 and sum(len(p.spans) for p in packs) == 601
    got = sound.loudness(spark, str(tmp_path), 0.25, 50)
    assert got.count() == 600 * 30 and sound.faults(spark, str(tmp_path)).count() == 1


def test_a_long_recording_is_many_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(sound, "RANGE_BYTES", 1000)
    samples = np.arange(5000) % 300
    (tmp_path / "a.wav").write_bytes(sound.wav_bytes(samples, 8, 2))
    reader = sound._WavReader({"path": str(tmp_path), "seconds": "1", "rangebytes": "90"})
    packs = reader.partitions()
    assert len(packs) == 11 and all(len(p.spans) == 1 for p in packs)
    rows = [r for p in packs for b in reader.read(p) for r in b.to_pylist()]
    mono = samples.reshape(-1, 2).mean(1)
    assert sum(r["n"] for r in rows) == 2500 and np.isclose(sum(r["squares"] for r in rows), (mono**2).sum())
    for win in (0, 100, 312):
        assert np.isclose(sum(r["squares"] for r in rows if r["win"] == win), (mono[win * 8 : win * 8 + 8] ** 2).sum())


def test_guarded_workbooks_are_made_by_many_tasks(spark):
    assert queries()["s03_workbook_guards"](spark, SF_DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
