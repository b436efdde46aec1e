"""Finite impulse responses, computed from their specification.

Windowed-sinc designs with a Hamming taper. Lengths follow the usual rule for
that taper, 3.3 divided by the transition width, rounded up to an odd number.
All kernels are symmetric, so applying them centred shifts no phase.
"""

from __future__ import annotations

import math

import numpy as np

# Pass band and line frequency.
PASS_HZ = (0.5, 40.0)
LINE_HZ = 60.0


def _length(width_hz: float, rate: float) -> int:
    taps = math.ceil(3.3 / width_hz * rate)
    return taps + 1 - taps % 2


def _lowpass(cut_hz: float, taps: int, rate: float) -> np.ndarray:
    n = np.arange(taps) - (taps - 1) / 2
    kernel = np.sinc(2 * cut_hz / rate * n) * np.hamming(taps)
    return kernel / kernel.sum()


def lowpass(cut_hz: float, width_hz: float, rate: float) -> list[float]:
    """Pass below ``cut_hz``; the transition of ``width_hz`` lies above it."""
    return _lowpass(cut_hz + width_hz / 2, _length(width_hz, rate), rate).tolist()


def bandpass(low_hz: float = PASS_HZ[0], high_hz: float = PASS_HZ[1], rate: float = 128.0) -> list[float]:
    """Transitions: a quarter of an edge, at least 2 Hz, as far as there is room."""
    below = min(max(0.25 * low_hz, 2.0), low_hz)
    above = min(max(0.25 * high_hz, 2.0), rate / 2 - high_hz)
    size = max(_length(below, rate), _length(above, rate))
    kernel = np.zeros(size)
    for sign, cut, width in ((1.0, high_hz + above / 2, above), (-1.0, low_hz - below / 2, below)):
        part = _lowpass(cut, _length(width, rate), rate)
        start = (size - len(part)) // 2
        kernel[start : start + len(part)] += sign * part
    return kernel.tolist()


def notch(line_hz: float = LINE_HZ, rate: float = 128.0, width_hz: float = 1.0) -> list[float]:
    """Stop a band around the line frequency (a 200th of it wide) and its two transitions."""
    side = width_hz / 2
    stop = line_hz / 200
    size = _length(side, rate)
    low = _lowpass(line_hz - stop / 2 - side / 2, size, rate)
    kernel = low
    upper = line_hz + stop / 2 + side / 2
    if upper < rate / 2:
        kernel = low - _lowpass(upper, size, rate)
        kernel[(size - 1) // 2] += 1.0
    return kernel.tolist()


def antialias(rate: float, factor: int) -> list[float]:
    """Low-pass for decimation: passes 80 % of the new Nyquist range."""
    nyquist = rate / 2 / factor
    return lowpass(0.8 * nyquist, 0.2 * nyquist, rate)
