"""What a key has to tell leaves in one frame."""

from __future__ import annotations

import pandas as pd

from cuesmith.streaming.changes import _Active


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.timers = []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_a_key_tells_its_spells_in_one_frame():
    own = _Active(1000)
    own.handle, own.last = _Handle(), _State()
    at = pd.to_datetime([5000, 100, 100, 9000, 8500], unit="ms") + pd.Timedelta("700us")
    frames = list(own.handleInputRows(("7",), iter([pd.DataFrame({"at": at[:2]}), pd.DataFrame({"at": at[2:]})]), None))
    assert len(frames) == 1 and own.handle.timers == [10000]
    assert list(frames[0].itertuples(index=False, name=None)) == [("7", 0.1, "active"), ("7", 0.1, "expired"), ("7", 5.0, "active"), ("7", 5.0, "expired"), ("7", 8.5, "active")]
