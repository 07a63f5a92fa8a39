"""Kernels against brute force, analytic cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremolith.errors import SignalTooLong, UnknownOperator
from tremolith.kernels import SPECS, dsp, get, optim, run
from tremolith.kernels import wavelets as wv

RNG = np.random.default_rng(42)
T = np.arange(1200) / 12000
SINE = np.sin(2 * np.pi * 78.5 * T)
NOISY = SINE + 0.3 * RNG.normal(size=1200)
#: These shorten their input by definition.
SHORTER = {"med_denoise", "mckdd_denoise", "momeda_denoise"}
SLOW = {"eemd_denoise", "iceemdan_denoise", "ceemd_denoise", "ceemdan_denoise", "kernel_pca_denoise", "subspace_denoise", "fista_denoise", "pso_optimized_rls", "jade_denoise", "svd_denoise", "hankel_svd"}


def test_the_catalog_is_whole():
    assert len(SPECS) == 91
    assert len({s.category for s in SPECS.values()}) == 14
    with pytest.raises(UnknownOperator):
        get("none_of_these")


@pytest.mark.parametrize("name", sorted(SPECS))
def test_shape_and_determinism(name):
    x = NOISY[:240] if name in SLOW else NOISY
    a, b = run(name, x, 12000.0), run(name, x, 12000.0)
    assert np.isfinite(a).all() and np.abs(a).max() > 0
    assert np.array_equal(a, b)
    if name not in SHORTER:
        assert a.shape == x.shape


@pytest.mark.parametrize("name", [s.id for s in SPECS.values() if s.max_length])
def test_size_guard(name):
    with pytest.raises(SignalTooLong):
        run(name, np.zeros(get(name).max_length + 1), 1000.0)


def response(sos, w):
    z = np.exp(-1j * np.pi * np.asarray(w))
    return np.abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z) for s in sos], axis=0))


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_edges(order):
    assert response(dsp.butter(order, 0.3, "low"), [1e-6, 0.3]) == pytest.approx([1, 2**-0.5], abs=1e-5)
    assert response(dsp.butter(order, 0.3, "high"), [1 - 1e-6, 0.3]) == pytest.approx([1, 2**-0.5], abs=1e-5)
    assert response(dsp.butter(order, [0.2, 0.5], "band"), [0.2, 0.5]) == pytest.approx([2**-0.5] * 2, abs=1e-5)
    assert response(dsp.butter(order, [0.2, 0.5], "stop"), [1e-6, 0.2, 0.5]) == pytest.approx([1, 2**-0.5, 2**-0.5], abs=1e-5)


@pytest.mark.parametrize("order", [3, 4, 5])
def test_elliptic_ripple(order):
    sos = dsp.ellip(order, 0.1, 40.0, [0.2, 0.5], "band")
    inside, outside = response(sos, np.linspace(0.2, 0.5, 400)), response(sos, np.concatenate([np.linspace(0.01, 0.08, 100), np.linspace(0.8, 0.99, 100)]))
    assert inside.min() >= 10 ** (-0.1 / 20) - 1e-6 and inside.max() <= 1 + 1e-6
    assert outside.max() <= 10 ** (-40 / 20) + 1e-6


def test_notch_and_fir():
    b, a = dsp.notch(0.2, 10.0)
    z = np.exp(-1j * np.pi * np.array([1e-9, 0.2]))
    assert np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) == pytest.approx([1, 0], abs=1e-6)
    taps = dsp.kaiser_band(0.2, 0.5, 0.05, 60.0)
    assert len(taps) % 2 == 1 and np.allclose(taps, taps[::-1])
    assert abs(np.sum(taps * np.exp(-1j * np.pi * 0.05 * np.arange(len(taps))))) < 2e-3


def test_zero_phase_filters_keep_constants_and_phase():
    ones = np.full(200, 3.0)
    assert dsp.sosfiltfilt(dsp.butter(4, 0.2, "low"), ones) == pytest.approx(ones)
    tone = np.cos(2 * np.pi * 0.01 * np.arange(1000))
    y = dsp.sosfiltfilt(dsp.butter(4, 0.2, "low"), tone)
    assert y[100:-100] == pytest.approx(tone[100:-100], abs=1e-4)
    with pytest.raises(ValueError):
        run("low_pass_butterworth", NOISY, 1000.0, {"cutoff_freq": 500.0})


def test_direct_form_matches_the_difference_equation():
    b, a, x = np.array([0.2, 0.3, 0.1]), np.array([1.0, -0.5, 0.25]), RNG.normal(size=50)
    y = np.zeros(50)
    for n in range(50):
        y[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
    assert dsp.lfilter(b, a, x, np.zeros(2)) == pytest.approx(y)


@settings(max_examples=25, deadline=None)
@given(st.integers(16, 200), st.sampled_from(["db4", "db8", "sym8"]), st.integers(1, 4), st.integers(0, 99))
def test_wavelets_rebuild(n, name, level, seed):
    x = np.random.default_rng(seed).normal(size=n)
    assert wv.waverec(wv.wavedec(x, name, level), name)[:n] == pytest.approx(x)
    assert wv.packet(x, name, level, lambda c: c) == pytest.approx(x)
    assert wv.best_basis(x, name, level, lambda c: c)[1] == pytest.approx(x)


def test_wavelet_taps_are_orthonormal():
    for name in ("db2", "db4", "db8", "sym8"):
        h = wv.scaling_taps(name)
        assert h.sum() == pytest.approx(2**0.5)
        for k in range(0, len(h), 2):
            assert np.dot(h[k:], h[: len(h) - k]) == pytest.approx(float(k == 0), abs=1e-7)


def test_stft_and_resample_round_trip():
    _, z = dsp.stft(NOISY, 1.0, 64, 32)
    assert dsp.istft(z, 64, 32)[:1200] == pytest.approx(NOISY)
    tone = np.sin(2 * np.pi * np.arange(64) / 16)
    assert dsp.fft_resample(tone, 128)[::2] == pytest.approx(tone)
    assert dsp.hilbert(np.cos(2 * np.pi * np.arange(64) / 8)).imag == pytest.approx(np.sin(2 * np.pi * np.arange(64) / 8))


def test_time_domain_against_loops():
    x, n = NOISY[:60], 60
    for w in (4, 5):
        slow = [sum(x[k] for k in range(i - w // 2, i + (w - 1) // 2 + 1) if 0 <= k < n) / w for i in range(n)]
        assert run("moving_average_filter", x, 1.0, {"window_size": w}) == pytest.approx(slow)
    padded = np.pad(x, 2)
    assert run("median_filter", x, 1.0) == pytest.approx([np.median(padded[i : i + 5]) for i in range(n)])
    cubic = np.polyval([0.1, -1, 2, 3], np.arange(40.0))
    assert run("savitzky_golay_filter", cubic, 1.0) == pytest.approx(cubic)
    low = [min(x[max(0, i - 2) : i + 3]) for i in range(n)]
    opened = run("morphological_filter", x, 1.0)
    assert opened == pytest.approx([max(low[max(0, i - 2) : i + 3]) for i in range(n)])
    assert run("morphological_filter", opened, 1.0) == pytest.approx(opened)  # idempotent


def test_adaptive_against_scalar_recursions():
    x = NOISY[:200]
    w, y = np.zeros(8), x.copy()
    for i in range(8, 200):
        u = x[i - 8 : i][::-1]
        y[i] = w @ u
        w = w + 2 * 0.01 * (x[i] - y[i]) * u
    assert run("lms_adaptive_filter", x, 1.0, {"filter_order": 8}) == pytest.approx(y)
    state, p, out = np.array([x[0], 0.0]), np.eye(2), []
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    for v in x:
        state, p = f @ state, f @ p @ f.T + 1e-5 * np.eye(2)
        k = (p @ h.T / (p[0, 0] + 1e-3)).ravel()
        state, p = state + k * (v - state[0]), (np.eye(2) - np.outer(k, h)) @ p
        out.append(state[0])
    assert run("kalman_filter", x, 1.0) == pytest.approx(out)


def test_compressed_sensing_is_greedy_pursuit():
    n, x = 48, NOISY[:48]
    d = np.array([np.sqrt((1 if k == 0 else 2) / n) * np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n)) for k in range(n)]).T
    rest, chosen = x.copy(), []
    for _ in range(5):
        chosen.append(int(np.argmax(np.abs(d.T @ rest))))
        rest = x - d[:, chosen] @ np.linalg.lstsq(d[:, chosen], x, rcond=None)[0]
    assert run("compressed_sensing_denoise", x, 1.0, {"sparsity": 5}) == pytest.approx(x - rest)


def test_ica_is_the_projection_on_components():
    x = NOISY[:150]
    assert run("ica_denoise", x, 1.0, {"n_components": 3}) == pytest.approx(run("pca_denoise", x, 1.0, {"n_components": 3}))
    assert run("pca_denoise", np.stack([x, 2 * x, x + 1]), 1.0, {"n_components": 1})[1] == pytest.approx(2 * x, abs=1e-8)


def test_modes_and_components_add_up():
    from tremolith.kernels.decomposition import imfs

    assert np.sum(imfs(NOISY[:300]), axis=0) == pytest.approx(NOISY[:300])
    assert run("itd_denoise", NOISY, 1.0, {"remove_first_n": 0}) == pytest.approx(NOISY)


def test_quirks_are_kept_and_can_be_corrected():
    step = np.r_[np.zeros(20), np.ones(20)] + 0.1 * RNG.normal(size=40)
    variation = lambda y: np.abs(np.diff(y)).sum()
    assert variation(run("total_variation_denoise", step, 1.0, {"corrected": True})) < variation(step) <= variation(run("total_variation_denoise", step, 1.0)) + 1e-9


def test_optimisers_find_known_optima():
    f, g = lambda p: float(np.sum((np.asarray(p) - 1) ** 2)), lambda p: 2 * (np.asarray(p) - 1)
    for x in (
        optim.batch_gradient_descent(g, [0, 0], 0.1), optim.adam_optimizer(g, [0.5, 0.5], 0.01), optim.newton_method(g, lambda p: 2 * np.eye(2), [0, 0]), optim.bfgs_optimize(f, g, [0, 0]),
        optim.particle_swarm_optimization(f, 2, [(-3, 3)] * 2, random_state=1)[0], optim.differential_evolution(f, [(-3, 3)] * 2, random_state=1)[0],
        optim.genetic_algorithm(lambda p: -f(p), 2, [(-3, 3)] * 2, random_state=1), optim.simulated_annealing(f, [0, 0], [(-3, 3)] * 2, max_iter_per_temp=10, random_state=1)[0],
        optim.gp_ucb_optimize(lambda p: -f(p), [(-3, 3)] * 2, n_iter=25, random_state=1, candidates=300)[0], optim.stochastic_gradient_descent(lambda p, i: g(p), [0, 0], 20),
    ):
        assert x == pytest.approx([1, 1], abs=0.25)
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    assert a @ optim.conjugate_gradient(a, np.array([1.0, 2.0])) == pytest.approx([1, 2])
    x = RNG.normal(size=(30, 3))
    assert optim.design_fir_cg(x, x @ [1.0, 2.0, 3.0]) == pytest.approx([1, 2, 3], abs=1e-4)


def test_adaptive_median_takes_even_windows_as_the_next_odd_ones():
    from tremolith.kernels import classic

    assert classic.odd_windows(2, 14) == (3, 15) and classic.odd_windows(1, 15) == (3, 15) and classic.odd_windows(4, 8) == (5, 9)


@pytest.mark.parametrize("kind", ["normal", "ties", "flat"])
def test_graph_of_nearest_values_equals_the_dense_one(kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=130), "ties": rng.integers(0, 5, 130).astype(float), "flat": np.zeros(40)}[kind]
    n = len(x)
    d = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    a = np.zeros((n, n))
    np.put_along_axis(a, near, np.exp(-(np.take_along_axis(d, near, 1) ** 2) / 2), 1)
    a = (a + a.T) / 2
    assert run("graph_signal_denoise", x, 1.0) == pytest.approx(np.linalg.solve(np.eye(n) + 0.5 * (np.diag(a.sum(axis=1)) - a), x))


def test_bounds_are_parameters_and_off():
    x = np.random.default_rng(5).normal(size=700)
    for name, params in (("ksvd_denoise", {"max_codings": 20, "n_iter": 2, "dict_size": 8}), ("non_local_means_denoise", {"full_length": 200}), ("graph_signal_denoise", {"full_length": 100})):
        bounded, whole = run(name, x, 1.0, params), run(name, x, 1.0, {k: v for k, v in params.items() if k not in ("max_codings", "full_length")})
        assert len(bounded) == len(whole) == len(x)
    assert len(run("non_local_means_denoise", np.tile(x, 9), 1.0)) == 9 * len(x)
    short = x[:60]
    few, many = (run("eemd_denoise", short, 1.0, {"n_ensemble": n}) for n in (200, 210))
    assert not np.array_equal(few, many)  # trials beyond 200 count


def _plain_modes(x, most):
    """One signal at a time, with a dense solution of each spline."""

    def envelope(y, at):
        t = np.concatenate([-at[:2][::-1], at, 2 * (len(y) - 1) - at[-2:][::-1]]).astype(float)
        v = np.concatenate([y[at[:2][::-1]], y[at], y[at[-2:][::-1]]])
        h, a = np.diff(t), np.eye(len(t))
        right = np.zeros(len(t))
        for i in range(1, len(t) - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            right[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
        m, s = np.linalg.solve(a, right), np.arange(len(y))
        k = np.clip(np.searchsorted(t, s) - 1, 0, len(t) - 2)
        p, q = (t[k + 1] - s) / h[k], (s - t[k]) / h[k]
        return p * v[k] + q * v[k + 1] + ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1]) * h[k] ** 2 / 6

    out, rest = [], x.copy()
    while len(out) < most:
        turns = [i for i in range(1, len(x) - 1) if (rest[i] - rest[i - 1]) * (rest[i + 1] - rest[i]) < 0]
        high = np.array([i for i in turns if rest[i] > rest[i - 1]])
        if len(turns) < 4 or not 0 < len(high) < len(turns):
            break
        mode = rest.copy()
        for _ in range(10):
            turns = [i for i in range(1, len(x) - 1) if (mode[i] - mode[i - 1]) * (mode[i + 1] - mode[i]) < 0]
            high, low = (np.array([i for i in turns if (mode[i] > mode[i - 1]) == up], int) for up in (True, False))
            if min(len(high), len(low)) < 2:
                break
            mean = (envelope(mode, high) + envelope(mode, low)) / 2
            mode = mode - mean
            if np.sum(mean**2) < 1e-3 * np.sum(mode**2):
                break
        out.append(mode)
        rest = rest - mode
    return [*out, rest]


def test_modes_of_many_signals_equal_each_alone():
    from tremolith.kernels.decomposition import imfs_of

    x = np.array([NOISY[:90], np.zeros(90), np.arange(90.0), NOISY[90:180], np.cumsum(NOISY[:90])])
    for most in (0, 1, 12):
        found = imfs_of(x, most)
        for r, row in enumerate(x):
            for k, m in enumerate(found):
                plain = _plain_modes(row, most)
                assert m[r] == pytest.approx(plain[k] if k < len(plain) else np.zeros(90), abs=1e-9)


@pytest.mark.parametrize("first", [0, 1, 3])
def test_ensembles_take_apart_only_what_is_removed(first, monkeypatch):
    from tremolith.kernels import decomposition

    x, rng, asked = NOISY[:80], np.random.default_rng(7), []
    noisy = [x + 0.2 * np.std(x) * rng.normal(size=80) for _ in range(6)]
    whole = sum((m for y in noisy for m in _plain_modes(y, 12)[first:]), np.zeros(80)) / 6
    of = decomposition.imfs_of
    monkeypatch.setattr(decomposition, "imfs_of", lambda x, most: asked.append((len(x), most)) or of(x, most))
    assert run("eemd_denoise", x, 1.0, {"n_ensemble": 6, "remove_first_n": first, "seed": 7}) == pytest.approx(whole, abs=1e-9)
    assert asked == [(6, first)]


def test_genetic_search_takes_one_pursuit(monkeypatch):
    from tremolith.kernels import specialised

    asked, of = [], specialised.omp_path
    monkeypatch.setattr(specialised, "omp_path", lambda *a: asked.append(a[2]) or of(*a))
    found = run("ga_optimized_omp", NOISY[:70], 1.0)
    assert asked == [30]
    d = specialised.gabor(70, 70, 1.0)
    merit = [specialised._snr(NOISY[:70], of(NOISY[:70], d, s)[-1]) - 0.05 * s for s in range(1, 31)]
    assert found == pytest.approx(of(NOISY[:70], d, 1 + int(np.argmax(merit)))[-1], abs=1e-9)


def test_pursuit_is_least_squares_also_over_dependent_atoms():
    from tremolith.kernels.decomposition import omp_path

    d = RNG.normal(size=(40, 12))
    d = np.hstack([d, d + 1e-9 * RNG.normal(size=(40, 12))])
    d /= np.linalg.norm(d, axis=0)
    chosen, rest, x = [], NOISY[:40], NOISY[:40]
    for fit in omp_path(x, d, 10):
        chosen.append(int(np.argmax(np.abs(d.T @ rest))))
        rest = x - d[:, chosen] @ np.linalg.lstsq(d[:, chosen], x, rcond=None)[0]
        assert fit == pytest.approx(x - rest, abs=1e-7)


def test_shared_draws_change_no_search():
    from tremolith.kernels.optim import _DRAWN, _NEAR, _SPREAD

    def best(k, candidates=200):
        return optim.gp_ucb_optimize(lambda p: -((p[0] - k) ** 2) - (p[1] + k / 2) ** 2, [(-3, 3)] * 2, 4, 12, random_state=9, candidates=candidates)

    fresh = []
    for k in range(6):
        for store in (_DRAWN, _NEAR, _SPREAD):
            store.clear()
        fresh.append(best(k))
    again = [best(k) for k in range(6)]
    assert all(np.array_equal(a[0], b[0]) and a[1] == b[1] for a, b in zip(fresh, again, strict=True))
    assert len(_NEAR) <= 128 and len(_SPREAD) <= 1024 and len(_DRAWN) == 1
    best(1, candidates=5000)
    assert len(_DRAWN) == 1  # too much to be kept


@pytest.mark.parametrize("name", ["pso_optimized_lms", "pso_optimized_rls"])
def test_swarms_move_together_as_each_alone(name, monkeypatch):
    together, of = [], optim.particle_swarm_optimization

    def alone(f, *a, together, **k):
        return of(lambda p: float(f(np.array([p]))[0]), *a, **k)

    def counted(f, *a, **k):
        return of(lambda p: together.append(len(p)) or f(p), *a, **k)

    monkeypatch.setattr(optim, "particle_swarm_optimization", counted)
    found = run(name, NOISY[:80], 1.0)
    assert together == [15] * 21
    monkeypatch.setattr(optim, "particle_swarm_optimization", alone)
    assert run(name, NOISY[:80], 1.0) == pytest.approx(found, abs=1e-9)


def test_rls_swarm_judges_every_sample(monkeypatch):
    """The cost of a forgetting factor is the whole prediction's mean squared error."""
    x, asked, of = NOISY[:200], [], optim.particle_swarm_optimization
    monkeypatch.setattr(optim, "particle_swarm_optimization", lambda f, *a, **k: asked.append(f) or of(f, *a, **k))
    run("pso_optimized_rls", x, 1.0)
    for factor in (0.8, 0.93, 1.0):
        y = run("rls_adaptive_filter", x, 1.0, {"filter_order": 16, "lambda_": factor})
        assert asked[0](np.array([[factor]]))[0] == pytest.approx(np.mean((x[16:] - y[16:]) ** 2), rel=1e-6)


def test_jade_leaves_out_the_first_source():
    """Every source of the customary deflation, of which the first one goes."""
    x = np.stack([NOISY[:200], SINE[:200] + RNG.normal(size=200) / 5, RNG.uniform(size=200), NOISY[300:500]])
    u, s, v = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)
    white, rng, w = v * np.sqrt(200), np.random.default_rng(42), np.zeros((4, 4))
    for i in range(4):
        b = rng.normal(size=4)
        for _ in range(200):
            b = b - w[:i].T @ (w[:i] @ b)
            b /= np.linalg.norm(b)
            y = np.tanh(b @ white)
            new = (white * y).mean(axis=1) - (1 - y * y).mean() * b
            new -= w[:i].T @ (w[:i] @ new)
            new /= np.linalg.norm(new)
            done, b = abs(abs(new @ b) - 1) < 1e-4, new
            if done:
                break
        w[i] = b
    whole = (u * s) @ w.T / np.sqrt(200)
    assert run("jade_denoise", x, 1.0) == pytest.approx(whole[:, 1:] @ (w @ white)[1:], abs=1e-9)


def test_variational_modes_over_half_a_spectrum_equal_the_whole():
    from tremolith.kernels.decomposition import vmd

    for x in (NOISY[:70], NOISY[:71]):
        n, k, alpha, tau = len(x), 3, 500.0, 0.1
        half = n // 2
        z = np.fft.fft(np.concatenate([x[:half][::-1], x, x[n - half :][::-1]]))
        f = np.fft.fftfreq(len(z))
        up, w, u, dual = np.where(f >= 0, z, 0), 0.5 * np.arange(k) / k, np.zeros((k, len(z)), complex), np.zeros(len(z), complex)
        for _ in range(40):
            last = u.copy()
            for i in range(k):
                u[i] = np.where(f >= 0, (up - (u.sum(axis=0) - u[i]) - dual / 2) / (1 + alpha * (f - w[i]) ** 2), 0)
                w[i] = (f * np.abs(u[i]) ** 2).sum() / (np.abs(u[i]) ** 2).sum()
            dual = dual + tau * (u.sum(axis=0) - up)
            if np.sum(np.abs(u - last) ** 2) / len(z) <= 1e-9:
                break
        u[:, 1 : (len(z) + 1) // 2] *= 2
        assert vmd(x, alpha, tau, k, False, 1, 1e-9, most=40) == pytest.approx(np.fft.ifft(u, axis=1).real[:, half : half + n], abs=1e-8)
