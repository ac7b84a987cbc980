"""Design of Butterworth filters as second-order sections, and running them with carried state."""

from __future__ import annotations

import numpy as np

#: Sections are rows b0 b1 b2 1 a1 a2.
Sections = np.ndarray


def _prototype(order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def _warp(f: float, sr: float) -> float:
    return 2 * sr * np.tan(np.pi * f / sr)


def butterworth(order: int, kind: str, edges: tuple[float, ...], sr: float) -> Sections:
    """Low-pass ("low", one edge), band-pass ("pass") or band-stop ("stop", two edges) by the bilinear transform.

    The edges are where the gain is 1/sqrt(2).  A band filter of order n has 2 n poles.
    """
    p = _prototype(order)
    if kind == "low":
        w = _warp(edges[0], sr)
        poles, zeros = p * w, np.zeros(0, dtype=complex)
    else:
        lo, hi = (_warp(f, sr) for f in edges)
        width, centre = hi - lo, lo * hi
        half = (p if kind == "pass" else 1 / p) * width / 2
        root = np.sqrt(half**2 - centre + 0j)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(order, dtype=complex) if kind == "pass" else np.tile([1j, -1j], order) * np.sqrt(centre)
    digital = lambda s: (2 * sr + s) / (2 * sr - s)
    z = np.concatenate([digital(zeros), -np.ones(len(poles) - len(zeros))])
    q = digital(poles)
    sections = _paired(z, q)
    at = {"low": 0.0, "stop": 0.0, "pass": 2 * np.arctan(np.sqrt(_warp(edges[0], sr) * _warp(edges[-1], sr)) / (2 * sr))}[kind]
    for s in sections:  # each section has a gain of 1 in the middle of the pass band, so none over- or underflows
        s[:3] /= abs(response(s[None, :], np.array([at]))[0])
    return sections


def _paired(zeros: np.ndarray, poles: np.ndarray) -> Sections:
    """A section for each two poles, conjugates together; those nearest to the circle last, with the zeros nearest to them."""
    upper = sorted(poles[poles.imag > 1e-12], key=abs)
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [(a, b) for a, b in zip(real[::2], real[1::2], strict=False)] + [(q, q.conjugate()) for q in upper]
    if len(real) % 2:
        pairs.insert(0, (real[-1], 0.0))
    rest = list(zeros)
    if len(rest) < 2 * len(pairs):
        rest += [0.0] * (2 * len(pairs) - len(rest))
    out = []
    for p, q in reversed(pairs):
        rest.sort(key=lambda z: (abs(z - p), -np.imag(z)))
        a = rest.pop(0)
        if abs(np.imag(a)) > 1e-12:
            k = min(range(len(rest)), key=lambda i: abs(rest[i] - np.conj(a)))
        else:
            k = min((i for i in range(len(rest)) if abs(np.imag(rest[i])) <= 1e-12), key=lambda i: -abs(rest[i] - p))
        b = rest.pop(k)
        out.append([*np.real(np.poly([a, b])), *np.real(np.poly([p, q]))])
    return np.array(out[::-1])


def response(sections: Sections, w: np.ndarray) -> np.ndarray:
    """Complex gain at angles w (pi: half the rate)."""
    z = np.exp(-1j * np.asarray(w, dtype=float))
    out = np.ones(len(z), dtype=complex)
    for b0, b1, b2, a0, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z)
    return out


def steady_state(sections: Sections) -> np.ndarray:
    """State of each section (sections x 2) under a constant input of 1."""
    out, level = np.zeros((len(sections), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[k] = level * (gain - b0), level * (b2 - a2 * gain)
        level *= gain
    return out


def run(sections: Sections, x: np.ndarray, state: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(y, state) of samples x (time x channels) and states (sections x 2 x channels), in transposed direct form II.

    A section is linear, so a block's output is a matrix times its input plus a matrix times the state before it.
    """
    y, state = np.array(x, dtype=float), state.copy()
    for k, section in enumerate(sections):
        whole = _block(section, min(block, max(1, len(y))))
        for lo in range(0, len(y), block):
            hi = min(lo + block, len(y))
            io, so, ii, ss = whole if hi - lo == len(whole[0]) else _block(section, hi - lo)
            piece = y[lo:hi].copy()
            y[lo:hi] = io @ piece + so @ state[k]
            state[k] = ii @ piece + ss @ state[k]
    return y, state


def _block(section: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input to output, state to output, input to end state, state to end state) over n samples of a section."""
    b0, b1, b2, _, a1, a2 = section
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    push = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(n):
        powers.append(step @ powers[-1])
    so = np.array([p[0] for p in powers[:n]])
    impulse = np.concatenate([[b0], so[: n - 1] @ push]) if n > 1 else np.array([b0])
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    io = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    ii = np.stack([powers[n - 1 - j] @ push for j in range(n)], axis=1)
    return io, so, ii, powers[n]


def transition(sections: Sections, n: int) -> np.ndarray:
    """What n zeros make of a state, as a matrix on the flattened (sections x 2) states."""
    size = 2 * len(sections)
    _, end = run(sections, np.zeros((n, size)), np.eye(size).reshape(len(sections), 2, size))
    return end.reshape(size, size)


def cold(sections: Sections, first: np.ndarray) -> np.ndarray:
    """The state in which each channel has always had its first sample."""
    return steady_state(sections)[:, :, None] * first


def warm(sections: Sections, channels: int, zeros: int) -> np.ndarray:
    """The steady state, not scaled by any sample, after that many zeros: how a stream starts."""
    _, state = run(sections, np.zeros((zeros, channels)), np.repeat(steady_state(sections)[:, :, None], channels, axis=2))
    return state


def high_gamma(sr: float, line: int = 50) -> list[Sections]:
    """Band-pass 70 to 170 Hz, then stops at the harmonics of the mains within it."""
    stops = [(98.0, 102.0), (148.0, 152.0)] if line == 50 else [(118.0, 122.0)]
    return [butterworth(8, "pass", (70.0, 170.0), sr), *(butterworth(8, "stop", s, sr) for s in stops)]
