"""Signal-frame kernels: spectra of PCM, projections of them, and decoding of posteriorgrams to notes."""

from __future__ import annotations

import numpy as np


def spectrogram(x: np.ndarray, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Power of Hann-windowed frames; whole frames only."""
    if len(x) < size:
        return np.zeros((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    return np.abs(np.fft.rfft(frames, axis=1)) ** 2


def band_power(power: np.ndarray, rate: int, edges: tuple[float, ...]) -> np.ndarray:
    """Summed power between each two edges in Hz."""
    hz = np.fft.rfftfreq(2 * (power.shape[1] - 1), 1 / rate)
    return np.stack([power[:, (hz >= a) & (hz < b)].sum(axis=1) for a, b in zip(edges, edges[1:], strict=False)], axis=1)


def chroma_power(power: np.ndarray, rate: int, lowest: float = 55.0, highest: float = 5000.0) -> np.ndarray:
    """Summed power of each pitch class."""
    hz = np.fft.rfftfreq(2 * (power.shape[1] - 1), 1 / rate)
    use = (hz >= lowest) & (hz <= highest)
    pitch = np.round(69 + 12 * np.log2(hz[use] / 440)).astype(int) % 12
    out = np.zeros((len(power), 12))
    np.add.at(out.T, pitch, power[:, use].T)
    return out


def cepstra(bands: np.ndarray, count: int) -> np.ndarray:
    """The first coefficients of a cosine transform of log bands."""
    n = bands.shape[1]
    basis = np.cos(np.pi / n * (np.arange(n) + 0.5)[:, None] * np.arange(count)[None, :])
    return np.log(np.maximum(bands, 1e-12)) @ basis


def separated_peaks(strength: np.ndarray, separation: int, window: int, above: float) -> list[int]:
    """Inner local maxima `above` or more over the mean within `window`, each `separation` or more after the last one taken."""
    n = len(strength)
    if n < 3:
        return []
    sums = np.concatenate(([0.0], np.cumsum(strength)))
    at = np.arange(n)
    lo, hi = np.maximum(at - window, 0), np.minimum(at + window + 1, n)
    over = strength - (sums[hi] - sums[lo]) / (hi - lo) >= above - 1e-12
    top = np.zeros(n, dtype=bool)
    top[1:-1] = (strength[1:-1] >= strength[:-2]) & (strength[1:-1] > strength[2:])
    found, out, i = np.flatnonzero(top & over), [], 0
    while i < len(found):
        out.append(int(found[i]))
        i = int(np.searchsorted(found, found[i] + separation))
    return out


def flux_onsets(power: np.ndarray, separation: int, window: int = 3, above: float = 0.1) -> list[int]:
    """Peaks of the summed rises of log power."""
    logs = np.log1p(power)
    rise = np.concatenate(([0.0], np.maximum(np.diff(logs, axis=0), 0).sum(axis=1))) if len(power) else np.zeros(0)
    top = rise.max() if len(rise) else 0
    return separated_peaks(rise / top if top > 0 else rise, separation, window, above)


def harmonic_energy(power: np.ndarray, rate: int, midi: np.ndarray, harmonics: int = 4) -> np.ndarray:
    """Power at the harmonics of each frame's pitch; 0 where there is none."""
    size = 2 * (power.shape[1] - 1)
    out = np.zeros(len(power))
    for k in range(1, harmonics + 1):
        at = np.round(440 * 2 ** ((np.nan_to_num(midi, nan=-999) - 69) / 12) * k * size / rate).astype(int)
        ok = ~np.isnan(midi) & (at < power.shape[1])
        out[ok] += power[np.flatnonzero(ok), at[ok]]
    return out


def decode_posteriors(frames: np.ndarray, onsets: np.ndarray, onset_level: float = 0.5, frame_level: float = 0.3, least: int = 3, patience: int = 3) -> list[tuple[int, int, int, float]]:
    """(first, last + 1, pitch, mean level) of notes in posteriorgrams (frames x pitches), from the last onset back.

    A note goes on until `patience` frames in a row are below the level, and uses up what it covers.
    """
    left = frames.copy()
    top = np.zeros_like(onsets, dtype=bool)
    if len(onsets) > 2:
        top[1:-1] = (onsets[1:-1] > onsets[:-2]) & (onsets[1:-1] >= onsets[2:])
    out = []
    for t, p in sorted(zip(*np.nonzero(top & (onsets >= onset_level)), strict=True), key=lambda x: (-x[0], x[1])):
        end, quiet = t + 1, 0
        while end < len(left) and quiet < patience:
            quiet = quiet + 1 if left[end, p] < frame_level else 0
            end += 1
        end -= quiet
        if end - t >= least:
            out.append((int(t), int(end), int(p), float(left[t:end, p].mean())))
            left[t:end, p] = 0
    return sorted(out)


#: Fixed values, in pulses but for the last: how near two intervals come to one pulse, how short a doubled one is, how long a short
#: pair may be; and a frame of the tracker in seconds.
PAIR_FIT, SHORT, PAIR_MOST, FRAME = 0.15, 0.75, 1.4, 0.02


def drop_doubled(beats: np.ndarray, pulses: np.ndarray, tolerance: float = 0.15) -> list[float]:
    """Beats without the middle ones of two intervals that make one pulse together, or of a short pair between ordinary intervals.

    pulses: the reference of the interval after each beat but the last. The interval before a beat is from the last beat kept.
    """
    if len(beats) < 4:
        return [float(t) for t in beats]
    ordinary = lambda gap, pulse: abs(gap / pulse - 1) <= tolerance
    kept = [float(beats[0])]
    following = [*np.diff(beats)[2:], None]  # the interval after the next beat
    for here, then, pulse, beyond in zip(beats[1:-1], beats[2:], pulses[1:], following, strict=True):
        doubled = False
        if pulse > 0:
            short, long = sorted(((here - kept[-1]) / pulse, (then - here) / pulse))
            doubled = short < SHORT and abs(short + long - 1) <= PAIR_FIT + FRAME / pulse
            if long < SHORT and short + long <= PAIR_MOST and len(kept) > 1 and beyond is not None:
                doubled |= ordinary(kept[-1] - kept[-2], pulse) and ordinary(beyond, pulse)
        if not doubled:
            kept.append(float(here))
    return [*kept, float(beats[-1])]
