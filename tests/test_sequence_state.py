"""What the sequence operator asks of its state store does not grow with the windows of a batch."""

import pandas as pd

from signalloom.streaming.twins import LastWindows


class Store:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.now = 0, 0

    def getValueState(self, name, schema):
        return Value(self)

    def getMapState(self, name, key, value):
        return Map(self)

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer

    def getCurrentWatermarkInMs(self):
        return self.now


class Value:
    def __init__(self, store):
        self.store, self.held = store, None

    def exists(self):
        self.store.calls += 1
        return self.held is not None

    def get(self):
        self.store.calls += 1
        return self.held

    def update(self, value):
        self.store.calls += 1
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    def __init__(self, store):
        self.store = store

    def iterator(self):
        self.store.calls += 1
        return iter(self.items())

    def updateValue(self, key, value):
        self.store.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        self.pop(key)


def batch(first, n):
    index = range(first, first + n)
    return pd.DataFrame({"window_index": index, "value": [float(i) for i in index], "ms": [1000 * i for i in index]})


def started(hold_ms=10_000):
    store, windows = Store(), LastWindows(5, 4096, 256, hold_ms)
    windows.init(store)
    return store, windows


def test_calls_of_a_batch_are_few_whatever_its_windows():
    store, windows = started()
    key, seen = ("s", "r", 0), []
    for first, n in ((0, 300), (300, 1), (301, 400)):
        store.calls = 0
        made = pd.concat(list(windows.handleInputRows(key, iter([batch(first, n)]), store)))
        assert store.calls <= 6
        seen += made["target_index"].tolist()
        assert all(list(v) == [float(t - 4 + k) for k in range(5)] for t, v in zip(made["target_index"], made["values"]))
    assert seen == list(range(4, 701))


def test_a_timer_that_expires_before_its_chunk_is_moved_on():
    store, windows = started()
    key = ("s", "r", 0)
    list(windows.handleInputRows(key, iter([batch(0, 3)]), store))
    list(windows.handleInputRows(key, iter([batch(3, 7)]), store))
    store.now = 13_000  # the first timer is due, the newest window at 9,000 is held until 19,000
    assert list(windows.handleExpiredTimer(key, store, None)) == [] and windows.newest.held is not None
    store.now = 19_000
    list(windows.handleExpiredTimer(key, store, None))
    assert windows.newest.held is None and windows.held.held is None
