"""Order-dependent folds over a bounded history: benchmark ladder, breaker, autoscaler.

Each key's history (a machine, an encoder) is one group; keys are spread.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ladder_steps(rounds: DataFrame, machine: str) -> DataFrame:
    """(machine, concurrency, rate, stable): the lower median rate of a step's
    rounds; stable if every round was."""
    return rounds.groupBy(machine, "concurrency").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rate)").alias("rate"), F.bool_and("ok").alias("stable"))


def recommend(steps: DataFrame, machine: str, gain: float = 0.05) -> DataFrame:
    """(machine, concurrency): the highest stable step, or lower while a step's gain
    over the stable one below it is under `gain`; 1 where none is stable."""
    ladder = F.array_sort(F.collect_list(F.when(F.col("stable"), F.struct("concurrency", "rate"))))
    first = F.struct(F.lit(0).cast("int").alias("at"), F.lit(False).alias("stop"))
    below = lambda xs, i: F.get(xs, i)

    def walk(xs):
        n = F.size(xs)
        steps_down = F.sequence(n - 1, F.lit(1), F.lit(-1))
        start = F.struct((n - 1).alias("at"), F.lit(False).alias("stop"))

        def step(acc, i):
            cur, prev = below(xs, i)["rate"], below(xs, i - 1)["rate"]
            keep = acc["stop"] | (prev <= 0) | ((cur - prev) / prev >= gain)
            return F.struct(F.when(keep, acc["at"]).otherwise(i - 1).alias("at"), keep.alias("stop"))

        return F.when(n > 1, F.aggregate(steps_down, start, step)["at"]).otherwise(first["at"])

    g = steps.groupBy(machine).agg(ladder.alias("xs"))
    return g.select(machine, F.when(F.size("xs") == 0, 1).otherwise(F.get("xs", walk(F.col("xs")))["concurrency"]).alias("concurrency"))


class Breaker:
    """closed, open and half-open with one leased probe; times are the events' own."""

    def __init__(self, failures: int = 5, open_seconds: float = 30.0, lease: float = 20.0, state: tuple | None = None):
        self.most, self.open_seconds, self.lease = failures, open_seconds, lease
        self.state, self.failed, self.until, self.probe = state or ("closed", 0, 0.0, 0.0)

    def on(self, kind: str, at: float, retry_after: float | None = None) -> bool | None:
        """The answer to ``ask`` (may a call go out), None for other events."""
        if kind == "ask":
            if self.probe and at >= self.probe:  # a probe that never came back counts as failed
                self.state, self.until, self.probe = "open", at + self.open_seconds, 0.0
                return False
            if self.state == "closed":
                return True
            if self.state == "open" and at < self.until or self.probe:
                return False
            self.state, self.probe = "half_open", at + self.lease
            return True
        if kind == "ok":
            self.state, self.failed, self.until, self.probe = "closed", 0, 0.0, 0.0
        elif kind == "fail":
            self.failed, self.probe = self.failed + 1, 0.0
            if self.state == "half_open" or self.failed >= self.most:
                self.state, self.until = "open", at + (retry_after or self.open_seconds)
        return None

    def values(self) -> tuple[str, int, float, float]:
        return self.state, self.failed, self.until, self.probe


def replay_breaker(events: DataFrame, key: str, **settings) -> DataFrame:
    """(key, seq, allowed, state) after each of a key's events (seq, at, kind, retry_after) in order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        breaker, rows = Breaker(**settings), []
        for e in group.sort_values("seq").itertuples():
            allowed = breaker.on(e.kind, e.at, None if pd.isna(e.retry_after) else e.retry_after)
            rows.append((group[key].iloc[0], e.seq, allowed, breaker.state))
        return pd.DataFrame(rows, columns=[key, "seq", "allowed", "state"]).astype({"allowed": "boolean"})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "seq", "at", "kind", "retry_after").groupBy(key).applyInPandas(run, f"{key} {kind}, seq long, allowed boolean, state string")


def scale_decisions(samples: Iterable, recommended: int, most: int, cooldown: float = 8.0, window: float = 60.0, hysteresis: float = 0.05, safe_gb: float = 5.0) -> list[tuple[int, bool, str]]:
    """(target, apply, why) of each sample (at, backlog, free_gb, throughput,
    breaker_open, saturated, hw_failure): halved at three failures in the window,
    one while the breaker is open, no growth on a full disk, a saturated fallback,
    without backlog or without gain, and no change while cooling down."""
    now, resized, signal, failures, out = 0, float("-inf"), 0.0, [], []
    for s in samples:
        failures = [t for t in failures if t >= s.at - window] + [s.at] * bool(s.hw_failure)
        cooled, base = s.at - resized >= cooldown or now == 0, min(recommended, most)
        if s.breaker_open:
            target, why = 1, "breaker"
        elif len(failures) >= 3:
            target, why = max(1, now // 2), "failures"
        elif now and base > now and s.free_gb < safe_gb:
            target, why, cooled = now, "disk", False
        elif now and base > now and s.saturated:
            target, why, cooled = now, "saturated", False
        else:
            want = min(base, max(1, now)) if s.backlog <= 0 and now else base
            if now and want > now and signal > 0 and s.throughput > 0 and (s.throughput - signal) / signal < hysteresis:
                want = now
            target, why = min(most, max(1, want)), "plan"
        apply = cooled and target != now
        if apply:
            signal = s.throughput if why == "plan" else signal
            now, resized = target, s.at
        out.append((target, apply, why))
    return out


def replay_scaler(samples: DataFrame, key: str, recommended: int, most: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        rows = scale_decisions(group.itertuples(), recommended, most)
        return pd.DataFrame({key: group[key].to_numpy(), "at": group["at"].to_numpy(), "target": [r[0] for r in rows], "applied": [r[1] for r in rows], "why": [r[2] for r in rows]})

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandas(run, f"{key} {kind}, at double, target long, applied boolean, why string")
