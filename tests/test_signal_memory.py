"""A batch of filtered chunks holds its own samples only."""

import tracemalloc

import numpy as np
import pyarrow as pa

from signalloom.functions import filters
from signalloom.operators import signals as sg


def test_short_chunks_do_not_keep_their_transforms(spark):
    taps = filters.notch()
    x = np.random.default_rng(1).normal(size=(2000, 67))
    samples, none = pa.array(list(x), pa.list_(pa.float64())), pa.array([[]] * len(x), pa.list_(pa.float64()))
    run = sg._chain([(taps, 1)], len(taps) // 2).func
    run(none, samples, none)
    tracemalloc.start()
    out = run(none, samples, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * x.nbytes  # one transform of a chunk has 2,048 numbers
    half = len(taps) // 2
    for i in (0, 1999):
        wide = sg.reflected(x[i], half, True, True)
        assert np.allclose(out.field("samples")[i].as_py(), np.convolve(wide, taps, "valid"))
