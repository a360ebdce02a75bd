"""Digital filters in numpy: designs as second-order sections, and zero-phase filtering.

Filters run on matrices with one column per series, so that a loop over samples
handles all series of a batch at once.
"""

from __future__ import annotations

from math import factorial

import numpy as np


def analog_prototype(order: int, kind: str = "butter", ripple: float = 5.0) -> tuple[np.ndarray, float]:
    """Poles and gain of an analog low-pass with its corner at 1 rad/s; kinds butter, cheby1, bessel."""
    k = np.arange(1, order + 1)
    angle = np.pi * (2 * k - 1) / (2 * order)
    if kind == "butter":
        return np.exp(1j * (angle + np.pi / 2)), 1.0
    if kind == "cheby1":
        eps = np.sqrt(10 ** (ripple / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = -np.sinh(mu) * np.sin(angle) + 1j * np.cosh(mu) * np.cos(angle)
        gain = np.prod(-poles).real
        return poles, gain / np.sqrt(1 + eps**2) if order % 2 == 0 else gain
    if kind == "bessel":
        # Roots of the reverse Bessel polynomial, scaled so that far above the corner it falls like a Butterworth filter.
        rev = [factorial(2 * order - i) / (2 ** (order - i) * factorial(i) * factorial(order - i)) for i in range(order + 1)]
        poles = np.roots(rev[::-1]) / rev[0] ** (1 / order)
        return poles, 1.0
    raise ValueError(f"unknown filter {kind}")


def sections(order: int, corners, btype: str = "bandpass", kind: str = "butter", ripple: float = 5.0) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a digital filter; corners as fractions of the Nyquist frequency."""
    corners = np.atleast_1d(np.asarray(corners, float))
    if (corners <= 0).any() or (corners >= 1).any() or len(corners) == 2 and corners[0] >= corners[1]:
        raise ValueError("corners must rise between 0 and the Nyquist frequency")
    poles, gain = analog_prototype(order, kind, ripple)
    warped = 4 * np.tan(np.pi * corners / 2)
    if btype == "low":
        poles, zeros = poles * warped[0], np.zeros(0, complex)
        gain *= warped[0] ** order
    elif btype == "high":
        gain = gain / np.prod(-poles).real
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    elif btype == "bandpass":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros = np.r_[half + root, half - root], np.zeros(order, complex)
        gain *= width**order
    else:
        raise ValueError(f"unknown band {btype}")
    degree = len(poles) - len(zeros)
    gain *= (np.prod(4 - zeros) / np.prod(4 - poles)).real
    poles, zeros = (4 + poles) / (4 - poles), np.r_[(4 + zeros) / (4 - zeros), -np.ones(degree)]
    return pair_up(zeros, poles, gain)


def pair_up(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Real sections from zeros (all real) and poles (real or in conjugate pairs)."""
    zeros = sorted(zeros.real, key=lambda z: -z)
    paired = [(p, p.conjugate()) for p in poles if p.imag > 1e-12]
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    while len(real) > 1:
        paired.append((real.pop(), real.pop(0)))
    if real:
        paired.append((real[0], None))
    out = []
    for k, (p, q) in enumerate(sorted(paired, key=lambda x: abs(x[0]))):
        a = np.poly([p] if q is None else [p, q]).real
        # A zero from either end: band-passes get one at 1 and one at -1 in each section.
        own = [zeros.pop(0)] if q is None else [zeros.pop(0), zeros.pop()]
        b = np.poly(own)
        out.append(np.r_[b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))])
    out = np.array(out)
    out[0, :3] *= gain
    return out


def filter_sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Filter the columns of ``x``; ``state``: (sections, 2) at a constant input of 1, scaled by the first row."""
    y = np.array(x, float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = (state[k][:, None] * y[0][None, :]) if state is not None else (np.zeros(y.shape[1]), np.zeros(y.shape[1]))
        if state is not None and k:
            scale = np.prod([s[:3].sum() / s[3:].sum() for s in sos[:k]])
            z1, z2 = state[k][0] * scale * x[0], state[k][1] * scale * x[0]
        out = np.empty_like(y)
        for i, v in enumerate(y):
            w = b0 * v + z1
            z1 = b1 * v - a1 * w + z2
            z2 = b2 * v - a2 * w
            out[i] = w
        y = out
    return y


def steady_state(sos: np.ndarray) -> np.ndarray:
    """For each section the two delays after a long constant input of 1."""
    out = []
    for b0, b1, b2, _, a1, a2 in sos:
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * y
        out.append([y - b0, z2])
    return np.array(out)


def zero_phase(sos: np.ndarray, x: np.ndarray, padding: int) -> np.ndarray:
    """Filter forwards and backwards over columns, edges continued by point reflection."""
    if len(x) <= padding:
        raise ValueError(f"series of {len(x)} are too short for a padding of {padding}")
    wide = np.vstack([2 * x[0] - x[padding:0:-1], x, 2 * x[-1] - x[-2 : -padding - 2 : -1]]) if padding else x
    state = steady_state(sos)
    once = filter_sections(sos, wide, state)
    twice = filter_sections(sos, once[::-1], state)[::-1]
    return twice[padding : len(wide) - padding]


def padding_of(order: int, btype: str) -> int:
    """Three times the length of the transfer function's polynomials."""
    return 3 * ((2 * order if btype == "bandpass" else order) + 1)


def fir_bandpass(taps: int, low: float, high: float) -> np.ndarray:
    """Windowed-sinc band-pass with a Hamming window, of gain 1 at the middle of the band."""
    m = np.arange(taps) - (taps - 1) / 2
    h = (high * np.sinc(high * m) - low * np.sinc(low * m)) * np.hamming(taps)
    return h / np.sum(h * np.cos(np.pi * m * (low + high) / 2))


def operator_matrix(f, n: int) -> np.ndarray:
    """The matrix of a linear operator on series of length n."""
    return f(np.eye(n))


def median_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Median over an odd window with zeros beyond the ends."""
    half = width // 2
    padded = np.r_[np.zeros(half), x, np.zeros(half)]
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)


def peaks(x: np.ndarray, prominence: float = 0.0, width: float = 0.0) -> np.ndarray:
    """Local maxima of at least a prominence and, at half of it, a width (in samples)."""
    x = np.asarray(x, float)
    found = []
    i = 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    out = []
    for p in found:
        left, right = p, p
        low_l = low_r = x[p]
        while left > 0 and x[left - 1] <= x[p]:
            left -= 1
            low_l = min(low_l, x[left])
        while right < len(x) - 1 and x[right + 1] <= x[p]:
            right += 1
            low_r = min(low_r, x[right])
        rise = x[p] - max(low_l, low_r)
        if rise < prominence:
            continue
        level = x[p] - rise / 2
        a = p
        while left < a and x[a] > level:
            a -= 1
        lo = a + (level - x[a]) / (x[a + 1] - x[a]) if x[a] < level else float(a)
        b = p
        while b < right and x[b] > level:
            b += 1
        hi = b - (level - x[b]) / (x[b - 1] - x[b]) if x[b] < level else float(b)
        if hi - lo >= width:
            out.append(p)
    return np.array(out, int)
