"""The state of a stream's bouts is read and written by parts, not bout by bout."""

import datetime as dt

import pandas as pd

from driftloom.streaming import drift as SD


class Held:
    def __init__(self):
        self.value, self.calls = None, 0

    def _called(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._called(self.value is not None)

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def containsKey(self, key):  # noqa: N802
        return self._called(False)

    def updateValue(self, key, value):  # noqa: N802
        self._called()


class Handle:
    def __init__(self):
        self.state = Held()

    def getValueState(self, *_):  # noqa: N802
        return self.state

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, _):  # noqa: N802
        pass


def test_a_batch_of_many_bouts_takes_a_few_calls_of_state():
    handle, bouts = Handle(), SD.BoutMoments()
    bouts.init(handle)
    key = ("a", "x", dt.date(2024, 5, 1), 3)
    rows = pd.DataFrame([(f"b{i}", 2, [1.0 * i, 1.0], [2.0 * i, 1.0]) for i in range(1000)], columns=["bout", "n", "sx", "sxx"])
    first = pd.concat(bouts.handleInputRows(key, iter([rows, rows[:10]]), None))
    assert handle.state.calls <= 4 and len(first) == 1000
    again = pd.concat(bouts.handleInputRows(key, iter([rows[5:20]]), None)).set_index("bout")
    assert len(again) == 15 and handle.state.calls <= 8
    assert (again.loc["b7", "n"], again.loc["b7", "sx"], again.loc["b15", "n"], again.loc["b15", "sxx"]) == (6, [21.0, 3.0], 4, [60.0, 2.0])
    closed = pd.concat(bouts.handleExpiredTimer(key, None, None))
    assert len(closed) == 1000 and closed["closed"].all() and closed["n"].sum() == 2 * (1000 + 10 + 15)
