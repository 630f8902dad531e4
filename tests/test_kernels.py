"""Kernels against independent computations and planted changes."""

import math

import numpy as np
import pytest

from geocadence.functions import special
from geocadence.operators import kernels as k

RNG = np.random.default_rng(3)


def test_special_functions():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert special.chi2_quantile(0.95, 4) == pytest.approx(9.487729037, abs=1e-6)
    assert special.f_upper(4.0, 3, 20) == pytest.approx(0.0221, abs=2e-4)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_whittaker_solves_its_equations():
    t, y = np.arange(20) * 8.0, RNG.normal(size=20)
    y[[3, 7]] = np.nan
    z = k.whittaker(t, y, 5.0)
    d = np.diff(np.eye(20), 2, axis=0)
    w = np.isfinite(y).astype(float)
    assert np.allclose((np.diag(w) + 5.0 * d.T @ d) @ z, w * np.nan_to_num(y))
    assert np.isnan(k.whittaker(t, np.full(20, np.nan))).all()


def test_savgol_keeps_parabolas():
    x = np.arange(15.0)
    assert np.allclose(k.savgol(3 + 2 * x - 0.5 * x * x), 3 + 2 * x - 0.5 * x * x)


def test_desawtooth_removes_a_spike():
    y = np.array([1.0, 1.0, 9.0, 1.0, 1.0])
    assert np.allclose(k.desawtooth(y), 1.0)


def test_mann_kendall_counts():
    v = np.array([1.0, 3.0, 2.0, 5.0, 5.0, 7.0])
    s, var = k.mk_counts(v)
    assert s == sum(np.sign(v[j] - v[i]) for i in range(6) for j in range(i + 1, 6))
    assert var == pytest.approx((6 * 5 * 17 - 2 * 1 * 9) / 18)
    got = k.mann_kendall(np.arange(6.0), v, "original")
    assert got["z"] == pytest.approx((s - 1) / math.sqrt(var))
    assert k.mann_kendall(np.arange(3.0), v[:3]) is None


def test_nnls_and_unmix():
    a = np.abs(RNG.normal(size=(6, 3)))
    f = np.array([[0.2, 0.5, 0.3], [0.0, 1.0, 0.0]])
    got, rmse = k.unmix(a, f @ a.T)
    assert np.allclose(got, f, atol=1e-4) and np.all(rmse < 1e-4)


def test_landtrendr_finds_a_step():
    y = np.full(20, 8000.0) + RNG.normal(0, 40, 20)
    y[9:] -= 3000
    got = k.landtrendr(np.arange(2000.0, 2020.0), y)
    drops = np.diff(got["values"])
    at = got["years"][int(np.argmin(drops))]
    assert abs(int(at) - 2008) <= 1 and drops.min() < -2500
    flat = k.landtrendr(np.arange(2000.0, 2020.0), np.full(20, 5.0))
    assert flat["n_vertices"] == 2


def _seasonal(n=120, drop_at=90, drop=0.3):
    t = np.arange(n) * 30.4
    y = 0.5 + 0.2 * np.cos(2 * np.pi * t / 365.25) + RNG.normal(0, 0.02, n)
    y[drop_at:] -= drop
    return t, y


def test_bfast_monitor_and_lite_and_ewmacd():
    t, y = _seasonal()
    got = k.bfast_monitor(t, y, t[80], frequency=365.25, order=1)
    assert got["has_break"] and t[88] <= got["breakpoint"] <= t[100]
    assert not k.bfast_monitor(t, _seasonal(drop=0.0)[1], t[80], frequency=365.25, order=1, crit=3.0)["has_break"]
    lite = k.bfast_lite(t, y, frequency=365.25)
    assert lite["n_breaks"] >= 1 and min(abs(np.array(lite["breaks"]) - t[90])) <= 65
    chart = k.ewmacd(t, y, t[70])
    assert chart["break_time"] is not None and t[88] <= chart["break_time"] <= t[95]


def test_ccdc_breaks_once():
    t = np.arange(0, 16 * 200, 16.0)
    y = 3000 + 500 * np.cos(2 * np.pi * t / 365.25) + RNG.normal(0, 25, 200)
    y[120:] -= 1500
    got = k.ccdc(t, y, y * 0.5)
    breaks = [s["t_break"] for s in got["segments"] if s["t_break"] is not None]
    assert len(breaks) == 1 and abs(breaks[0] - t[120]) <= 64


def test_twdtw_prefers_its_own_pattern():
    t = np.arange(0, 365, 16.0)
    up, down = np.sin(t / 365 * np.pi), np.cos(t / 365 * np.pi)
    assert k.twdtw(t, up, t, up) < k.twdtw(t, up, t, down)
    assert k.twdtw(t, np.full(len(t), np.nan), t, up) == math.inf


def test_tmask_and_omnibus_and_coded():
    t = np.arange(0, 800, 16.0)
    green, swir = np.full(len(t), 600.0) + RNG.normal(0, 5, len(t)), np.full(len(t), 1500.0)
    green[20] = 4000
    assert not k.tmask(t, green, swir)["clear"][20]
    a = RNG.gamma(4.4, 1 / 4.4, (30, 2))
    a[18:] *= 12
    got = k.omnibus(t[:30], a[:, 0], a[:, 1])
    assert got["n_changes"] >= 1 and got["first_direction"] == 1
    tt, y = _seasonal()
    assert k.coded(tt, y)["n_events"] >= 1
