"""Learning stand-ins, rotating-machine, acoustic, advanced and tuned denoisers.

The DEEP_LEARNING operators are the deterministic filters that stand in where
no trained network exists: spectral roll-off, wavelet shrinkage, local Wiener.
"""

from __future__ import annotations

import json

import numpy as np

from . import classic, dsp, optim
from . import wavelets as wv
from .decomposition import gabor, omp_path
from .registry import get, operator

LEARNING, ROTATING, ACOUSTIC, ADVANCED, TUNED = "DEEP_LEARNING", "ROTATING_SPECIFIC", "ACOUSTIC", "ADVANCED", "OPTIMIZATION"


def roll_off(x, fs, ratio: float):
    """Keeps frequencies up to ``ratio`` of Nyquist, then a Gaussian skirt."""
    f, edge = np.fft.rfftfreq(len(x), 1 / fs), ratio * fs / 2
    skirt = np.exp(-(((f - edge) / (0.05 * fs)) ** 2))
    return np.fft.irfft(np.fft.rfft(x) * np.where(f <= edge, 1.0, skirt), len(x))


def local_wiener(x, size: int):
    """Zero-padded local mean and variance; the noise is the mean variance."""
    mean = classic.same_convolution(x, np.full(size, 1 / size))
    spread = classic.same_convolution(x * x, np.full(size, 1 / size)) - mean**2
    noise = spread.mean()
    return np.where(spread < noise, mean, mean + (x - mean) * (1 - noise / np.where(spread == 0, 1, spread)))


@operator(LEARNING, "MEDIUM", "autoencoder", max_length=100000, encoding_dim=16, hidden_dim=32, segment_length=256, overlap=0.5)
def dae_denoise(x, fs, **_):
    return roll_off(x, fs, 0.15)


@operator(LEARNING, "MEDIUM", "autoencoder", "cnn", max_length=100000, kernel_size=3, n_filters=16, segment_length=512, overlap=0.5)
def cda_denoise(x, fs, **_):
    return wv.shrunk(x, "db4", 3, lambda c: wv.universal(len(x), wv.robust_sigma(c[-1])))


@operator(LEARNING, "HIGH", "cnn", max_length=50000, n_layers=10, n_filters=32, kernel_size=3, segment_length=512, overlap=0.5)
def dncnn_denoise(x, fs, **_):
    return local_wiener(x, 5)


@operator(LEARNING, "HIGH", "unet", max_length=50000, n_channels=16, depth=4, segment_length=1024, overlap=0.5)
def unet_denoise(x, fs, **_):
    return roll_off(x, fs, 0.15)


@operator(LEARNING, "HIGH", "gan", latent_dim=16, n_iter=20, segment_length=256, overlap=0.5)
def gan_denoise(x, fs, **_):
    return wv.shrunk(x, "sym8", 4, lambda c: wv.universal(len(x), wv.robust_sigma(c[-1])))


@operator(LEARNING, "HIGH", "drsn", n_filters=16, depth=6, segment_length=512, overlap=0.5)
def drsn_denoise(x, fs, **_):
    return roll_off(x, fs, 0.15)


@operator(LEARNING, "HIGH", "tcn", "lstm", n_filters=16, kernel_size=3, n_lstm_units=32, segment_length=512, overlap=0.5)
def tcn_lstm_denoise(x, fs, **_):
    return local_wiener(x, 7)


@operator(LEARNING, "HIGH", "transformer", max_length=30000, d_model=32, n_heads=4, n_layers=2, dim_feedforward=64, segment_length=256, overlap=0.5)
def transformer_denoise(x, fs, **_):
    return roll_off(x, fs, 0.10)


def _deconvolution(x, order: int):
    """The matrix whose product with a filter is its valid convolution, and the
    solver of its normal equations."""
    m = np.lib.stride_tricks.sliding_window_view(x, order)[:, ::-1]
    inverse = np.linalg.inv(m.T @ m + 1e-10 * np.eye(order))
    return m, lambda target: inverse @ (m.T @ target)


def _period(x, fs) -> int:
    """Samples per repetition, from the envelope spectrum between 5 and 500 Hz."""
    f, n = np.fft.rfftfreq(len(x), 1 / fs), len(x)
    size = np.where((f >= 5) & (f <= 500), np.abs(np.fft.rfft(np.abs(dsp.hilbert(x)))), -1)
    k = int(np.argmax(size))
    return max(int(round(fs / f[k])), 2) if size[k] >= 0 and f[k] > 0 else max(n // 20, 2)


@operator(ROTATING, "HIGH", "deconvolution", "kurtosis", max_length=50000, filter_order=64, max_iter=30, termination_tol=1e-3)
def med_denoise(x, fs, filter_order, max_iter, termination_tol):
    order = min(int(filter_order), len(x) // 3)
    if order < 2:
        return x.copy()
    m, solve = _deconvolution(x, order)
    f = np.zeros(order)
    f[order // 2], last = 1.0, None
    for _ in range(max_iter):
        y = m @ f
        spread = y.std(ddof=1)
        sharp = np.mean((y - y.mean()) ** 4) / spread**4 if len(y) >= 4 and spread else 0.0
        if last is not None and abs(sharp - last) < termination_tol:
            break
        last, new = sharp, solve(y**3)
        if np.linalg.norm(new) < 1e-15:
            break
        f = new / np.linalg.norm(new)
    return m @ f


@operator(ROTATING, "HIGH", "deconvolution", "correlated-kurtosis", max_length=50000, filter_order=64, period=None, max_iter=30, n_shift=1)
def mckdd_denoise(x, fs, filter_order, period, max_iter, n_shift):
    m, solve = _deconvolution(x, min(int(filter_order), len(x) // 3))
    lags = [k * max(int(period or _period(x, fs)), 2) for k in range(1, n_shift + 1)]
    f, last = np.full(m.shape[1], 1 / np.sqrt(m.shape[1])), None
    for _ in range(max_iter):
        y = m @ f
        power = np.sum(y * y)
        if power == 0:
            break
        ck = len(y) * sum(np.sum((y[:-k] * y[k:]) ** 2) for k in lags if k < len(y)) / power ** (n_shift + 1)
        if last is not None and abs(ck - last) < 1e-3:
            break
        last = ck
        ahead = sum((np.concatenate([y[k:], np.zeros(k)]) for k in lags if k < len(y)), np.zeros(len(y)))
        new = solve(y * ahead / power)
        if np.linalg.norm(new) < 1e-15:
            break
        f = new / np.linalg.norm(new)
    return m @ f


def _to_rms(y, x):
    rms = np.sqrt(np.mean(y * y))
    return y * (np.sqrt(np.mean(x * x)) / rms) if rms > 1e-15 else y


@operator(ROTATING, "MEDIUM", "deconvolution", "comb", filter_order=64, period=None)
def momeda_denoise(x, fs, filter_order, period):
    m, solve = _deconvolution(x, min(int(filter_order), len(x) // 3))
    step = max(int(period or _period(x, fs)), 2)
    comb = np.zeros(len(m))
    comb[step - 1 :: step] = 1
    f = solve(comb)
    return _to_rms(m @ (f / max(np.linalg.norm(f), 1e-15)), x)


@operator(ROTATING, "HIGH", "kurtogram", n_levels=6, threshold=0.7)
def spectral_kurtosis_filter(x, fs, n_levels, threshold=None):
    best = None
    for level in range(int(n_levels)):
        size = min(32 << level, len(x) // 2, 8192)
        if size < 8:
            continue
        f, z = dsp.stft(x, fs, size, size // 2, boundary=False)
        power = np.abs(z) ** 2
        sk = np.maximum(np.mean((power / np.maximum(power.mean(axis=1, keepdims=True), 1e-30)) ** 2, axis=1) - 2, 0)
        if len(sk) > 2 and (best is None or sk[2:].max() > best[0]):
            k = 2 + int(np.argmax(sk[2:]))
            best = (sk[k], f[k], fs / 2 / len(f))
    if best is None:
        return x.copy()
    _, centre, width = best
    half = 1.5 * width
    low, high = max(0.0, centre - half), min(fs / 2, centre + half)
    if high - low < 0.01 * fs:
        low, high = max(0.0, centre - 0.02 * fs), min(fs / 2, centre + 0.02 * fs)
    if not 0 < low < high < fs / 2:
        return x.copy()
    return dsp.sosfiltfilt(dsp.butter(4, [2 * low / fs, 2 * high / fs], "band"), x)


@operator(ROTATING, "LOW", "envelope", "hilbert", bp_low=None, bp_high=None, order=4)
def envelope_demodulation(x, fs, bp_low, bp_high, order):
    if bp_low is not None and bp_high is not None and 0 < bp_low < bp_high < fs / 2:
        x = dsp.sosfiltfilt(dsp.butter(order, [2 * bp_low / fs, 2 * bp_high / fs], "band"), x)
    return np.abs(dsp.sosfiltfilt(dsp.butter(order, min(0.2, 0.95), "low"), np.abs(dsp.hilbert(x))))


@operator(ROTATING, "HIGH", "cyclostationary", max_length=200000, n_cyclic_freqs=10, max_cyclic_freq_ratio=0.5)
def cyclostationary_analysis(x, fs, n_cyclic_freqs, max_cyclic_freq_ratio):
    n = len(x)
    size = min(256, n // 4)
    size = size if size >= 32 else min(32, n // 2)
    _, z = dsp.stft(x, fs, size, size // 2, n_fft=1 << (size - 1).bit_length(), boundary=False)
    frames = z.shape[1]
    most = int(frames // 2 * max_cyclic_freq_ratio)
    if most < 1:
        return x.copy()
    gamma = np.abs(np.fft.fft(np.abs(z) ** 2, axis=1)[:, :most]).sum(axis=0)
    gamma[0] = 0
    gamma = gamma / (gamma.max() or 1.0)
    alphas = np.fft.fftfreq(frames, 1 / fs)[:most]
    out = np.zeros(n)
    for k in np.argsort(gamma)[::-1][: int(n_cyclic_freqs)]:
        low, high = 0.7 * alphas[k], min(fs / 2, 1.3 * alphas[k])
        if gamma[k] > 0.05 and 0 < low < high < fs / 2:
            out += gamma[k] * dsp.sosfiltfilt(dsp.butter(2, [2 * low / fs, 2 * high / fs], "band"), x)
    return _to_rms(out, x) if np.abs(out).max() > 1e-15 else x.copy()


N_FFT, HOP = 512, 128


def _speech_gain(x, noise_frames: int, gain_of):
    """A gain per bin and frame by the decision-directed prior SNR."""
    pad = N_FFT - len(x) % HOP
    wide = np.pad(x, (0, pad), mode="reflect") if 0 < pad < N_FFT else x
    wide = np.pad(wide, (0, max(0, N_FFT - len(wide))))
    window = np.hanning(N_FFT)
    z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wide, N_FFT)[::HOP] * window, axis=1)
    power = np.abs(z) ** 2
    noise = np.maximum(power[:noise_frames].mean(axis=0), 1e-12)
    gain = np.ones(z.shape[1])
    for t in range(len(z)):
        post = power[t] / noise
        prior = np.maximum(0.98 * gain**2 * post + 0.02 * np.maximum(post - 1, 0), 1e-12)
        v = prior / (1 + prior) * post
        gain = np.where(v < 1e-12, 1.0, np.minimum(gain_of(prior, np.maximum(v, 1e-12)), 1.0))
        z[t] *= gain
    out, norm = np.zeros(HOP * (len(z) - 1) + N_FFT), np.zeros(HOP * (len(z) - 1) + N_FFT)
    for t, frame in enumerate(np.fft.irfft(z, N_FFT, axis=1) * window):
        out[t * HOP : t * HOP + N_FFT] += frame
        norm[t * HOP : t * HOP + N_FFT] += window**2
    return (out / np.where(norm > 1e-12, norm, 1.0))[: len(x)]


@operator(ACOUSTIC, "HIGH", "mmse", "speech", noise_estimation_frames=10)
def mmse_stsa_denoise(x, fs, noise_estimation_frames):
    return _speech_gain(x, int(noise_estimation_frames), lambda xi, v: np.sqrt(xi / (1 + xi) * (1 + v) / v))


# Polynomial approximations of the exponential integral E1, in 1/v above 1 and in v up to 1.
E1_ABOVE = (0.99999193, -0.24991055, 0.05519968, -0.00976004, 0.00107857)
E1_BELOW = (-0.57721566, 1.0, -1 / 4, 1 / 18, -1 / 96, 1 / 600)


def exponential_integral(v):
    above = np.exp(-v) / v * np.polyval(E1_ABOVE[::-1], 1 / v)
    return np.where(v > 1, above, np.polyval(E1_BELOW[::-1], np.minimum(v, 1)) - np.log(v))


@operator(ACOUSTIC, "HIGH", "log-mmse", "speech", noise_estimation_frames=10)
def log_mmse_denoise(x, fs, noise_estimation_frames):
    return _speech_gain(x, int(noise_estimation_frames), lambda xi, v: xi / (1 + xi) * np.exp(0.5 * exponential_integral(v)))


@operator(ACOUSTIC, "MEDIUM", "subspace", max_length=30000, n_components=None, subspace_factor=0.1)
def subspace_denoise(x, fs, n_components, subspace_factor):
    h = dsp.hankel(x, max(3, min(len(x) // 3, len(x) - 1)))
    rank = n_components or dsp.energy_rank(1 - subspace_factor)  # squared singular values are the eigenvalues
    return dsp.antidiagonal_mean(dsp.low_rank(h, rank))


@operator(ACOUSTIC, "LOW", "noise-gate", "realtime", threshold_db=-40, attack_ms=10, release_ms=100, hold_ms=50)
def noise_gate_denoise(x, fs, threshold_db, attack_ms, release_ms, hold_ms):
    n, size = len(x), max(1, int(fs * 0.01))
    hop = max(1, size // 2)
    count = max(1, (n - size) // hop + 1)
    frames = lambda ms: int(ms / 1000 * fs / hop)
    attack, release, hold = max(1, frames(attack_ms)), max(1, frames(release_ms)), max(0, frames(hold_ms))
    level = 10 ** (threshold_db / 20) if threshold_db > -120 else 0
    out, seen, gain, opened, held = np.zeros(n), np.zeros(n), 0.0, False, 0
    for t in range(count):
        part = x[t * hop : t * hop + size]
        if np.sqrt(np.mean(part**2)) >= level:
            opened, held = True, 0
        elif held < hold:
            held += 1
        else:
            opened = False
        gain += (opened - gain) / (attack if opened > gain else release)
        out[t * hop : t * hop + size] += part * min(max(gain, 0.0), 1.0)
        seen[t * hop : t * hop + size] += 1
    return out / np.maximum(seen, 1)


@operator(ADVANCED, "HIGH", "compressed-sensing", max_length=20000, sparsity=20, transform="dct")
def compressed_sensing_denoise(x, fs, sparsity, transform):
    """Greedy pursuit over an orthonormal basis keeps its largest coefficients."""
    n = len(x)
    if transform != "dct":
        z = np.fft.fft(x)
        keep = np.argsort(-np.abs(z), kind="stable")[: int(sparsity)]
        return np.fft.ifft(np.where(np.isin(np.arange(n), keep), z, 0)).real
    turn = np.exp(-1j * np.pi * np.arange(n) / (2 * n))
    z = np.fft.fft(np.concatenate([x[::2], x[1::2][::-1]]))
    c = (z * turn).real * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    keep = np.argsort(-np.abs(c), kind="stable")[: int(sparsity)]
    scale = np.where(keep == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    return np.cos(np.pi * np.outer(2 * np.arange(n) + 1, keep) / (2 * n)) @ (c[keep] * scale)


@operator(ADVANCED, "MEDIUM", "stochastic-resonance", max_length=100000, a=1.0, b=1.0, h=0.3)
def stochastic_resonance(x, fs, a, b, h):
    y, out = 0.0, []
    for s in x.tolist():
        k1 = a * y - b * y**3 + s
        p = y + h * k1 / 2
        k2 = a * p - b * p**3 + s
        p = y + h * k2 / 2
        k3 = a * p - b * p**3 + s
        p = y + h * k3
        k4 = a * p - b * p**3 + s
        y = min(max(y + h * (k1 + 2 * k2 + 2 * k3 + k4) / 6, -1e6), 1e6)
        out.append(y)
    out = np.array(out)
    out -= out.mean()
    return out * (x.std() / out.std()) if out.std() > 1e-12 else out


@operator(ADVANCED, "MEDIUM", "morphology", max_length=None, window_size=5, operation="opening")
def morphological_filter(x, fs, window_size, operation):
    w = int(window_size) | 1
    view = lambda y, fill: np.lib.stride_tricks.sliding_window_view(np.pad(y, w // 2, constant_values=fill), w)
    low, high = lambda y: view(y, np.inf).min(axis=1), lambda y: view(y, -np.inf).max(axis=1)
    opening, closing = lambda y: high(low(y)), lambda y: low(high(y))
    return {"opening": opening, "closing": closing, "occo": lambda y: closing(opening(y))}[operation](x)


@operator(ADVANCED, "MEDIUM", "total-variation", lambda_=0.1, n_iter=100)
def total_variation_denoise(x, fs, lambda_, n_iter, corrected=False):
    """Steps along x - y plus lambda times a sign term; by definition that term's
    sign sharpens, ``corrected`` turns it."""
    y, step, way = x.copy(), 0.5 / (1 + 4 * lambda_), -1 if corrected else 1
    for _ in range(int(n_iter)):
        s = np.sign(np.diff(y))
        y = y - step * (y - x + way * lambda_ * (np.append(s, 0) - np.append(0, s)))
    return y


@operator(ADVANCED, "HIGH", "non-local-means", max_length=50000, patch_size=7, search_radius=15, h=0.1, full_length=0)
def non_local_means_denoise(x, fs, patch_size, search_radius, h, full_length):
    """``full_length`` above 0: of longer signals patches and search shrink."""
    n, p, r = len(x), int(patch_size), int(search_radius)
    if full_length and n > full_length:
        scale = min(n / full_length, 4.0)
        p, r = max(2, int(p / scale)), max(3, int(r / scale))
    patches = np.lib.stride_tricks.sliding_window_view(np.pad(x, p, mode="reflect"), 2 * p + 1)
    total, weight = x.copy(), np.ones(n)
    for d in range(1, min(r, n - 1) + 1):
        w = np.exp(-np.sum((patches[d:] - patches[:-d]) ** 2, axis=1) / max(h * h, 1e-12))
        total[:-d] += w * x[d:]
        total[d:] += w * x[:-d]
        weight[:-d] += w
        weight[d:] += w
    return total / weight


def nearest_values(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k samples nearest in value to each, of equals those that come first: indices
    and distances [sample, k].  In order of values they lie within 2 k places, but for
    equal values, of which each run's first k + 1 are looked at as well."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    v, at = x[order], np.arange(n)
    run = np.concatenate(([0], 1 + np.flatnonzero(np.diff(v))))  # starts of runs of equal values
    first = run[np.searchsorted(run, at, "right") - 1]
    far = np.concatenate((at[:, None] + np.arange(-k, k + 1), first[:, None] + np.arange(k + 1)), axis=1)
    for side in (-1, 1):  # the runs where the window begins and ends, from their starts
        edge = np.clip(at + side * k, 0, n - 1)
        far = np.concatenate((far, run[np.searchsorted(run, edge, "right") - 1][:, None] + np.arange(k + 1)), axis=1)
    inside = (far >= 0) & (far < n)
    far = np.clip(far, 0, n - 1)
    index = order[far]
    d = np.where(inside & (far != at[:, None]), np.abs(v[:, None] - v[far]), np.inf)
    best = np.lexsort((index, d), axis=1)
    index, d = np.take_along_axis(index, best, 1), np.take_along_axis(d, best, 1)
    d[:, 1:][index[:, 1:] == index[:, :-1]] = np.inf  # met twice
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    out, size = np.empty((n, k), np.int64), np.empty((n, k))
    out[order], size[order] = np.take_along_axis(index, best, 1), np.take_along_axis(d, best, 1)
    return out, size


@operator(ADVANCED, "HIGH", "graph", "laplacian", max_length=200000, n_neighbors=10, sigma=1.0, alpha=0.5, full_length=0)
def graph_signal_denoise(x, fs, n_neighbors, sigma, alpha, full_length):
    """(I + alpha L) y = x over the graph of nearest values, by conjugate gradients on
    its few edges.  ``full_length`` above 0: of longer signals every step-th sample
    is taken, and what lies between is interpolated."""
    if full_length and len(x) > full_length:
        step = max(1, len(x) // 2000)
        few = graph_signal_denoise(x[::step], fs, n_neighbors, sigma, alpha, 0)
        return np.interp(np.arange(len(x)) / step, np.arange(len(few)), few)
    n, k = len(x), min(int(n_neighbors), len(x) - 1)
    if k < 1:
        return x.copy()
    near, d = nearest_values(x, k)
    i, j, w = np.repeat(np.arange(n), k), near.ravel(), np.exp(-(d.ravel() ** 2) / (2 * sigma**2)) / 2
    degree = np.bincount(i, w, n) + np.bincount(j, w, n)

    def apply(y):
        return y + alpha * (degree * y - np.bincount(i, w * y[j], n) - np.bincount(j, w * y[i], n))

    y, r = x.copy(), x - apply(x)
    p, size, goal = r.copy(), r @ r, 1e-24 * max(x @ x, 1e-300)
    for _ in range(10 * n):
        if size <= goal:
            break
        q = apply(p)
        step = size / (p @ q)
        y, r = y + step * p, r - step * q
        new = r @ r
        p, size = r + new / size * p, new
    return y


def hurst(x) -> float:
    """Rescaled-range exponent over up to 20 segment sizes, within [0, 1]."""
    n = len(x)
    if n < 4:
        return 0.5
    top = max(n // 2, 4)
    points = []
    for size in np.unique(np.logspace(np.log10(4), np.log10(top), min(20, top - 3), dtype=int)):
        part = x[: n // size * size].reshape(-1, size)
        walk = np.cumsum(part - part.mean(axis=1, keepdims=True), axis=1)
        spread = part.std(axis=1, ddof=1)
        ratio = np.where(spread > 1e-12, np.ptp(walk, axis=1) / np.maximum(spread, 1e-12), 0).mean()
        if ratio > 0:
            points.append((np.log(size), np.log(ratio)))
    return float(np.clip(np.polyfit(*zip(*points, strict=True), 1)[0], 0, 1)) if len(points) > 1 else 0.5


@operator(ADVANCED, "HIGH", "fractal", "hurst", max_length=200000, threshold=0.1, max_scale=10)
def fractal_denoise(x, fs, threshold, max_scale):
    level = min(int(max_scale), wv.max_level(len(x), "db4"))
    if level < 1:
        return x.copy()
    c = wv.wavedec(x, "db4", level)
    for i in range(1, len(c)):
        if len(c[i]) >= 4:
            w = min(1.0, abs(2 * hurst(c[i]) - 1))
            c[i] = c[i] * (w if w < threshold else threshold + (1 - threshold) * w)
    return wv.waverec(c, "db4")[: len(x)]


@operator(TUNED, "MEDIUM", "differential-evolution", "notch", noise_freq=50.0, f0_bounds=(45, 55), q_bounds=(10, 50), sample_rate=1000.0)
def de_optimized_iir_notch(x, fs, noise_freq, f0_bounds, q_bounds, sample_rate, corrected=False, seed=42):
    """The notch that the cost picks: by definition the cost rewards the level at
    ``noise_freq`` and takes the rate from the parameters; ``corrected`` rewards
    attenuation at the signal's own rate.  The search does not see the signal."""
    return dsp.filtfilt(*_best_notch(noise_freq, tuple(f0_bounds), tuple(q_bounds), fs if corrected else sample_rate, corrected, seed), x)


_NOTCHES: dict = {}


def _best_notch(*key):
    if key not in _NOTCHES:
        noise, f0, q, fs, corrected, seed = key
        w = np.arange(512) / 512 * fs / 2
        z = np.exp(-1j * np.pi * np.arange(512) / 512)
        at, far = int(np.argmin(np.abs(w - noise))), np.abs(w - noise) > 20

        def cost(p):
            b, a = dsp.notch(2 * p[0] / fs, p[1])
            db = 20 * np.log10(np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) + 1e-10)
            return (db[at] if corrected else -db[at]) + 0.1 * np.std(db[far])

        best, _ = optim.differential_evolution(cost, [f0, q], pop_size=30, max_iter=50, random_state=seed, tol=-np.inf if corrected else 1e-7)
        _NOTCHES[key] = dsp.notch(2 * best[0] / fs, best[1])
    return _NOTCHES[key]


@operator(TUNED, "MEDIUM", "particle-swarm", "lms", filter_order=32, mu_min=0.001, mu_max=0.5)
def pso_optimized_lms(x, fs, filter_order, mu_min, mu_max, seed=42):
    def together(mu):
        return lambda w, s, u, e: (w + (2 * mu * e)[:, None] * u, s)

    return _swarm(x, filter_order, 5, (mu_min, mu_max), together, lambda mu: lambda w, s, u, e: (w + 2 * mu * e * u, s), lambda: (np.zeros(filter_order), None), seed)


@operator(TUNED, "MEDIUM", "particle-swarm", "rls", filter_order=16, delta=0.1)
def pso_optimized_rls(x, fs, filter_order, delta, seed=42):
    def together(lam):
        def update(w, p, u, e):
            pu = np.matmul(p, u)
            k = pu / (lam + np.vecdot(pu, u))[:, None]
            p = p - k[:, :, None] * pu[:, None, :]
            p /= lam[:, None, None]
            return w + k * e[:, None], p

        return update

    return _swarm(x, filter_order, 1, (0.8, 1.0), together, classic._rls, lambda: (np.zeros(filter_order), np.eye(filter_order) / delta), seed)


def _swarm(x, order, stride, bounds, together, rule, start, seed):
    """A predictor whose one parameter minimises the error on every stride-th sample.
    ``together`` is the rule for the states of many particles [particle, ...]; particles
    that meet, as at the bounds they do, are worked out once."""
    known: dict[float, float] = {}

    def costs(p):
        new = np.array(sorted(set(p[:, 0].tolist()) - known.keys()))
        if len(new):
            update, (w, s), total, count = together(new), start(), np.zeros(len(new)), 0
            w, s = np.tile(w, (len(new), 1)), None if s is None else np.tile(s, (len(new), 1, 1))
            with np.errstate(over="ignore", invalid="ignore"):
                for i in range(order, len(x), stride):
                    past = x[i - order : i][::-1]
                    e = x[i] - np.vecdot(w, past)
                    w, s = update(w, s, past, e)
                    total, count = total + e * e, count + 1
            known.update(zip(new.tolist(), np.where(np.isfinite(total), total / max(count, 1), 1e300).tolist(), strict=True))
        return np.array([known[v] for v in p[:, 0].tolist()])

    best, _ = optim.particle_swarm_optimization(costs, 1, [bounds], n_particles=15, max_iter=20, random_state=seed, together=True)
    with np.errstate(over="ignore", invalid="ignore"):
        return classic.predict(x, order, rule(float(best[0])), start())


def _var(x) -> float:
    """np.var without its cost for short signals."""
    d = x - np.add.reduce(x) / len(x)
    return np.add.reduce(d * d) / len(x)


def _snr(x, y) -> float:
    return 10 * np.log10(_var(x) / (_var(x - y) + 1e-10) + 1e-300)


@operator(TUNED, "HIGH", "bayesian", "wavelet", wavelet="db4", threshold_mode="soft", n_init=5, n_iter=30)
def bayesian_optimized_wavelet(x, fs, wavelet, threshold_mode, n_init, n_iter, seed=42):
    deep = wv.wavedec(x, wavelet, 8)
    smooth = [x]
    for _ in deep[1:]:
        smooth.append(wv.dwt(smooth[-1], wavelet)[0])
    least = wv.universal(len(x), wv.robust_sigma(deep[-1]))

    def denoised(scale, level):
        details = [wv.shrink(d, scale * least, threshold_mode) for d in deep[-int(level) :]]
        return wv.waverec([smooth[int(level)], *details], wavelet)[: len(x)]

    best, _ = optim.gp_ucb_optimize(lambda p: _snr(x, denoised(*p)), [(0.5, 5.0), (1.0, 8.0)], n_init, n_iter, random_state=seed, candidates=500)
    return denoised(best[0], max(1, int(round(best[1]))))


@operator(TUNED, "MEDIUM", "bayesian", "kalman", n_init=8, n_iter=30)
def bayesian_optimized_kalman(x, fs, n_init, n_iter, seed=42):
    values = x[1:].tolist()

    def walk(q, r):
        y, p, q, r = float(x[0]), 1.0, float(q), float(r)  # floats of Python are the faster ones
        out = [y]
        for v in values:
            p += q
            gain = p / (p + r)
            y, p = y + gain * (v - y), (1 - gain) * p
            out.append(y)
        return np.array(out)

    best, _ = optim.gp_ucb_optimize(lambda p: _snr(x, walk(*p)), [(1e-5, 0.5)] * 2, n_init, n_iter, random_state=seed, candidates=500)
    return walk(*best)


@operator(TUNED, "HIGH", "genetic", "omp", max_sparsity=30, n_atoms=128)
def ga_optimized_omp(x, fs, max_sparsity, n_atoms, seed=42):
    """The search space is the integers up to max_sparsity: a genetic algorithm
    over it, over one pursuit's projections."""
    path = omp_path(x, gabor(len(x), min(int(n_atoms), len(x)), fs), max(1, int(round(max_sparsity)))) or [x.copy()]
    count = lambda p: max(1, int(round(float(p[0]))))
    at = lambda s: path[min(s, len(path)) - 1]
    merits = {s: _snr(x, at(s)) - 0.05 * s for s in range(1, max(1, int(round(max_sparsity))) + 1)}
    best = optim.genetic_algorithm(lambda p: merits[count(p)], 1, [(1, max_sparsity)], 20, 20, random_state=seed, enough=max(merits.values()))
    return at(count(best))


@operator(TUNED, "HIGH", "auto-tuning", algorithm_id="dwt_threshold_denoise", method="bayes", n_iter=30, param_bounds="{}")
def denoise_param_searcher(x, fs, algorithm_id, method, n_iter, param_bounds, seed=42):
    """Another operator under the parameters, of those within ``param_bounds``
    (JSON: name to [low, high]), that change the signal least."""
    spec = get(algorithm_id)
    bounds = json.loads(param_bounds)
    names = list(bounds)

    def at(p):
        given = {k: int(round(v)) if isinstance(spec.defaults.get(k), int) else float(v) for k, v in zip(names, p, strict=True)}
        return spec.kernel(x, fs, **(spec.defaults | given))[: len(x)]

    best = []
    if names and method == "bayes":
        best, _ = optim.gp_ucb_optimize(lambda p: _snr(x, at(p)), list(bounds.values()), min(10, n_iter // 3), n_iter, random_state=seed, candidates=500)
    elif names and method == "de":
        best, _ = optim.differential_evolution(lambda p: -_snr(x, at(p)), list(bounds.values()), 20, max_iter=n_iter, random_state=seed)
    return at(best)
