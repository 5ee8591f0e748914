"""Recurrences over batches of clips: a matrix has a clip in each row, and each step in time takes all clips at once.

Delay lines need no step in time: what they read is at least a delay old, so whole blocks of that length are computed.
Linear one-pole filters are summed by doubling, as powers of their coefficient fade.
"""

from __future__ import annotations

import math

import numpy as np

#: The comb and all-pass lengths of the reverb at 44100 Hz, and its presets (room, damping, wet, pre-delay ms).
COMBS = (1116, 1188, 1277, 1356, 1422, 1491, 1557, 1617)
ALL_PASS = (556, 441, 341, 225)
REVERBS = {"room": (0.3, 0.5, 0.3, 10), "hall": (0.8, 0.3, 0.4, 30), "plate": (0.6, 0.7, 0.35, 5), "cathedral": (0.95, 0.2, 0.5, 50)}
#: Bands (kind, Hz, gain dB, Q) of the equalizer's presets.
EQUALIZERS = {
    "voice": [("high_pass", 80, 0, 0.707), ("peak", 2500, 3, 1.5), ("high_shelf", 6000, 2, 0.707)],
    "bass": [("low_shelf", 100, 6, 0.707), ("peak", 60, 4, 0.8)],
    "treble": [("high_shelf", 8000, 4, 0.707), ("peak", 10000, 3, 1.0)],
}


def decay(ms: float, rate: int) -> float:
    return math.exp(-1000.0 / (ms * rate)) if ms * rate > 0 else 0.0


def envelope(x: np.ndarray, attack: float, release: float) -> np.ndarray:
    """A one-pole follower of the magnitude, with one coefficient up and another down."""
    level, out, now = np.abs(x), np.empty_like(x), np.zeros(len(x))
    for t in range(x.shape[1]):
        k = np.where(level[:, t] > now, attack, release)
        now = k * now + (1 - k) * level[:, t]
        out[:, t] = now
    return out


def compress(x: np.ndarray, rate: int, threshold_db: float, ratio: float, attack_ms: float, release_ms: float) -> np.ndarray:
    e = envelope(x, decay(attack_ms, rate), decay(release_ms, rate))
    over = e > 10 ** (threshold_db / 20)
    safe = np.where(over, e, 1.0)
    gain = np.where(over, 10 ** ((threshold_db + (20 * np.log10(safe) - threshold_db) / ratio) / 20) / safe, 1.0)
    return np.clip(x * gain, -1, 1)


def gate(x: np.ndarray, rate: int, threshold_db: float = -40, attack_ms: float = 1, release_ms: float = 100, range_db: float = -80) -> np.ndarray:
    attack, release, floor = decay(attack_ms, rate), decay(release_ms, rate), 10 ** (range_db / 20)
    over = envelope(x, attack, release) > 10 ** (threshold_db / 20)
    gain, out = np.full(len(x), floor), np.empty_like(x)
    for t in range(x.shape[1]):
        gain = np.where(over[:, t], gain * attack + (1 - attack), gain * release + floor * (1 - release))
        out[:, t] = x[:, t] * gain
    return out


def biquad_coefficients(kind: str, hz: float, gain_db: float, q: float, rate: int) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2 of the audio EQ cookbook, over a0."""
    a, w = 10 ** (gain_db / 40), 2 * math.pi * hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    if kind == "peak":
        b, d = (1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)
    elif kind in ("low_shelf", "high_shelf"):
        s = c if kind == "low_shelf" else -c
        flip = 1 if kind == "low_shelf" else -1
        root = 2 * math.sqrt(a) * alpha
        b = (a * ((a + 1) - (a - 1) * s + root), flip * 2 * a * ((a - 1) - (a + 1) * s), a * ((a + 1) - (a - 1) * s - root))
        d = ((a + 1) + (a - 1) * s + root, flip * -2 * ((a - 1) + (a + 1) * s), (a + 1) + (a - 1) * s - root)
    elif kind in ("low_pass", "high_pass", "notch"):
        b = {"low_pass": ((1 - c) / 2, 1 - c, (1 - c) / 2), "high_pass": ((1 + c) / 2, -(1 + c), (1 + c) / 2), "notch": (1.0, -2 * c, 1.0)}[kind]
        d = (1 + alpha, -2 * c, 1 - alpha)
    else:
        raise ValueError(f"unknown filter {kind}")
    return (*(v / d[0] for v in b), d[1] / d[0], d[2] / d[0])


def biquad(x: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    b0, b1, b2, a1, a2 = coefficients
    wide = np.pad(x, ((0, 0), (2, 0)))
    forward = b0 * wide[:, 2:] + b1 * wide[:, 1:-1] + b2 * wide[:, :-2]
    out = np.zeros_like(wide)
    for t in range(x.shape[1]):
        out[:, t + 2] = forward[:, t] - a1 * out[:, t + 1] - a2 * out[:, t]
    return out[:, 2:]


def equalizer(x: np.ndarray, rate: int, bands) -> np.ndarray:
    for band in EQUALIZERS[bands] if isinstance(bands, str) else bands:
        x = biquad(x, biquad_coefficients(*band, rate))
    return x


def one_pole(x: np.ndarray, k: float) -> np.ndarray:
    """y[t] = x[t] + k y[t - 1], by doubling."""
    y, step = x.copy(), 1
    while step < x.shape[1] and abs(k) ** step > 1e-18:
        y[:, step:] += k**step * y[:, :-step].copy()
        step *= 2
    return y


def feedback_line(x: np.ndarray, length: int, feedback: float) -> np.ndarray:
    """z[t] = x[t] + feedback z[t - length], block by block."""
    length, z = max(1, length), x.copy()
    for first in range(length, x.shape[1], length):
        last = min(x.shape[1], first + length)
        z[:, first:last] += feedback * z[:, first - length : last - length]
    return z


def late(x: np.ndarray, length: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (length, 0)))[:, : x.shape[1]]


def delay(x: np.ndarray, rate: int, ms: float, feedback: float, wet: float) -> np.ndarray:
    n = max(1, int(ms * rate / 1000))
    return x * (1 - wet) + late(feedback_line(x, n, max(0.0, min(0.95, feedback))), n) * wet


def reverb(x: np.ndarray, rate: int, room: float, damping: float, wet: float, pre_delay_ms: float) -> np.ndarray:
    """Eight damped combs side by side, then four all-pass lines in a row."""
    source = late(x, max(1, int(pre_delay_ms * rate / 1000))) * 0.015
    feedback, damp = room * 0.28 + 0.7, damping * 0.4
    total = np.zeros_like(x)
    for comb in COMBS:
        n = max(1, int(comb * rate / 44100))
        line, state = source.copy(), np.zeros((len(x), 1))
        for first in range(n, x.shape[1], n):
            last = min(x.shape[1], first + n)
            read = line[:, first - n : last - n] * (1 - damp)
            read[:, :1] += damp * state
            smooth = one_pole(read, damp)
            state = smooth[:, -1:]
            line[:, first:last] += feedback * smooth
        total += late(line, n)
    for n in (max(1, int(v * rate / 44100)) for v in ALL_PASS):
        stored = feedback_line(total, n, -0.5)
        total = total + 0.5 * late(stored, n)
    return x * (1 - wet) + total * wet


def _taps(history: np.ndarray, at: int, back: float) -> np.ndarray:
    place = at - back
    k = math.floor(place)
    read = lambda j: history[:, j] if 0 <= j <= at else np.zeros(len(history))
    return read(k) * (1 - (place - k)) + read(k + 1) * (place - k)


def chorus(x: np.ndarray, rate: int, hz: float = 1.5, depth: float = 0.5, ms: float = 20, wet: float = 0.5, voices: int = 2) -> np.ndarray:
    """Voices read a slowly swinging delay back; they are averaged."""
    base, out = ms * rate / 1000, np.empty_like(x)
    most = max(1, int(2 * base))
    for t in range(x.shape[1]):
        phase = 2 * math.pi * hz / rate * t
        backs = [max(1.0, base + math.sin(phase + v * math.pi / voices) * depth * base) for v in range(voices)]
        heard = sum(_taps(x, t, min(b, most)) for b in backs) / voices
        out[:, t] = x[:, t] * (1 - wet) + heard * wet
    return out


def flanger(x: np.ndarray, rate: int, hz: float = 0.5, depth: float = 0.7, feedback: float = 0.5, wet: float = 0.5) -> np.ndarray:
    """A delay of 1 sample to 10 ms that swings, with its output fed back."""
    most, line, out = max(1, int(rate / 100)), np.zeros_like(x), np.empty_like(x)
    heard = np.zeros(len(x))
    for t in range(x.shape[1]):
        line[:, t] = x[:, t] + heard * feedback
        back = max(1.0, 1 + (math.sin(2 * math.pi * hz / rate * t) + 1) / 2 * depth * most)
        heard = _taps(line, t, min(back, most))
        out[:, t] = x[:, t] * (1 - wet) + heard * wet
    return out


def spectrum(x: np.ndarray, n: int) -> np.ndarray:
    """Magnitudes of the first n // 2 bins of a Hann-windowed transform of the first n samples."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)))
    return np.abs(np.fft.rfft(x[:, :n] * window, axis=1))[:, : n // 2]


def log_bins(magnitudes: np.ndarray, bins: int) -> np.ndarray:
    """Means of bins that grow with the logarithm of the frequency."""
    m = magnitudes.shape[1]
    edge = [int(math.exp(k / bins * math.log(m)) + 1e-9) if m > 1 else 0 for k in range(bins + 1)]
    return np.stack([magnitudes[:, min(a, m - 1) : max(min(a, m - 1) + 1, b)].mean(1) for a, b in zip(edge, edge[1:])], 1)


def spectrogram(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """width columns of height log bins of one clip, over the greatest."""
    hop = max(1, len(x) // width)
    size = min(1024, 1 << max(1, len(x) - 1).bit_length())
    columns = [log_bins(spectrum(np.pad(x[k * hop : k * hop + size], (0, max(0, size - len(x[k * hop : k * hop + size]))))[None], size), height)[0] for k in range(width)]
    out = np.stack(columns, 1)
    return out / max(out.max(), 1e-12)
