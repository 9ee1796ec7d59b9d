"""Golden values of the formulas and properties of the kernels."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from borespark.functions import avo, crs, petro, selectors
from borespark.operators import frames, gathers, grid, neighborhood, time_depth, traces, well_tie


def values(df, column="value"):
    return [r[column] for r in df.collect()]


def one(spark, rows, schema, expression):
    return values(spark.createDataFrame(rows, schema).select(expression.alias("value")))


def test_vshale(spark):
    rows = [(30.0,), (65.0,), (100.0,), (None,), (float("nan"),)]
    assert one(spark, rows[:4], "gr double", petro.vshale_linear("gr")) == [0.0, 0.5, 1.0, None]
    assert one(spark, [(65.0,)], "gr double", petro.vshale_steiber("gr")) == pytest.approx([0.25])
    assert one(spark, [(65.0,), (300.0,)], "gr double", petro.vshale_clavier("gr")) == pytest.approx([1.7 - (3.38 - 1.44) ** 0.5, 1.0])
    with pytest.raises(ValueError):
        petro.vshale_linear("gr", 100, 30)


def test_elastic_set(spark):
    rows = list(zip([2200.0, 2500.0, 2800.0, 3000.0], [1200.0, 1400.0, 1600.0, 1700.0], [2.15, 2.22, 2.28, 2.35], strict=True))
    s = "vp double, vs double, rho double"
    assert one(spark, rows, s, petro.vp_vs_ratio("vp", "vs")) == pytest.approx([1.8333333333, 1.7857142857, 1.75, 1.7647058824])
    assert one(spark, rows, s, petro.shear_impedance("vs", "rho")) == pytest.approx([2580, 3108, 3648, 3995])
    assert one(spark, rows, s, petro.lambda_rho("vp", "vs", "rho")) == pytest.approx([4.214, 5.1726, 6.2016, 7.567])
    assert one(spark, rows, s, petro.mu_rho("vs", "rho")) == pytest.approx([3.096, 4.3512, 5.8368, 6.7915])
    assert one(spark, [(2000.0, -1.0, 2.0), (None, 1.0, 2.0), (2.0, 2.0, 2.0)], s, petro.poisson_ratio("vp", "vs")) == [None, None, None]
    assert one(spark, rows[:1], s, petro.strict(petro.vp_vs_ratio("vp", "vs"), "vp", "vs")) == pytest.approx([1.8333333333])
    with pytest.raises(PySparkException):
        one(spark, [(2000.0, -1.0, 2.0)], s, petro.strict(petro.vp_vs_ratio("vp", "vs"), "vp", "vs"))


def test_gassmann(spark):
    df = spark.createDataFrame([(2600.0, 1450.0, 2250.0, 24.0), (0.0, 1450.0, 2.2, 0.2), (None, 1450.0, 2.2, 0.0)], "vp double, vs double, rho double, phi double")
    r, *bad = petro.with_gassmann(df, "vp", "vs", "rho", "phi").collect()
    assert (r["density"], r["vp_after"], r["vs_after"]) == pytest.approx((2.058, 1964.8205678316335, 1516.130470473614))
    assert all(x["vp_after"] is None is x["vs_after"] for x in bad)


def test_reflectivity(spark):
    df = spark.createDataFrame([(2190.0, 716.0, 2.118, 2760.0, 1473.0, 2.229)], ", ".join(f"{n} double" for n in avo.NAMES))
    angles = [0, 10, 20, 30, 40]
    got = values(avo.reflectivity(df, angles), "reflectivity")
    assert got == pytest.approx([0.14068636, 0.12724227, 0.0885315, 0.029223174, -0.043529257], abs=1e-6)
    i = avo.Interface()
    assert df.select(i.intercept(), i.gradient()).first() == pytest.approx((0.14068636, -0.44585276), abs=1e-6)
    exact = avo.reflectivity(df, angles, "zoeppritz").collect()
    real = values(avo.reflectivity(df, angles, "zoeppritz_real"), "reflectivity")
    assert [r["re"] for r in exact] == pytest.approx(real) and all(abs(r["im"]) < 1e-12 for r in exact)
    assert all(values(avo.reflectivity(df, [0], m), "reflectivity")[0] == pytest.approx(real[0], abs=0.01) for m in avo.METHODS)
    with pytest.raises(PySparkException):
        avo.reflectivity(df, [80], "aki_richards", strict=True).collect()
    zero = spark.createDataFrame([(0.0, 0.0, 2.0, 2760.0, 0.0, 2.2)], ", ".join(f"{n} double" for n in avo.NAMES))
    assert [values(avo.reflectivity(zero, [10], m), "reflectivity") for m in avo.METHODS]


def test_units_and_names(spark):
    assert one(spark, [(-10.0,), (370.0,), (365.0,)], "a double", petro.normalise_azimuth("a")) == [350, 10, 5]
    assert one(spark, [(2.3,), (2300.0,), (0.0,), (float("inf"),)], "r double", petro.density_gcc("r")) == [2.3, 2.3, None, None]
    assert one(spark, [(0.2,), (20.0,), (-1.0,), (200.0,)], "p double", petro.porosity_fraction("p")) == [0.2, 0.2, None, None]
    assert one(spark, [("GR",), (" rhob",), ("?",)], "m string", petro.curve_kind("m")) == ["gamma_ray", "bulk_density", "unknown"]
    rows = [("GR_2", "gAPI"), ("XDENX", "kg/m3"), ("DTS4", "us/ft"), ("Q", "US/M"), ("Q", "gAPI"), ("Q", None)]
    assert one(spark, rows, "m string, u string", petro.curve_kind("m", "u")) == ["gamma_ray", "bulk_density", "shear_sonic", "sonic", "unknown", "unknown"]
    assert one(spark, [("True Vertical Depth",), (" MD",), ("x",)], "d string", petro.depth_domain("d")) == ["tvd", "md", None]
    assert one(spark, [("", "kelly bushing"), ("", "")], "d string, z string", petro.depth_domain("d", "z")) == ["md", None]
    assert one(spark, [("RT",), ("tvdss_m",), ("MSL",)], "r string", petro.depth_domain(F.lit(None), F.lit(None), "r")) == ["md", "tvdss", "md"]
    s = spark.createDataFrame([(1, "md", "kb"), (1, "md", None), (2, "md", "kb"), (2, "tvd", "gl"), (3, None, None)], "k int, depth_domain string, depth_datum string")
    assert {r["k"]: (r["reference"], r["datum"]) for r in petro.set_reference(s, ["k"]).collect()} == {1: ("md", "kb"), 2: ("unknown", "unknown"), 3: ("unknown", None)}
    assert petro.depth_unit(" feet") == "FT" and petro.depth_unit("km") is None
    names = [f"C[{i}]" for i in (10, 2, 1)]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(frames.natural_key(F.col("n")))
    assert values(df, "n") == ["C[1]", "C[2]", "C[10]"]


def test_moving_average_fills_and_shrinks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, None, None, None])], "w int, i int, v double")
    got = values(frames.moving_average(df, ["w"], ["i"], "v", 3).orderBy("i"), "smooth")
    assert got == [1.0, 2.0, 4.0, 4.0, 5.0, None, None]


def test_positional_join_refuses_what_does_not_align(spark):
    a = spark.createDataFrame([(1, 0, 10.0), (1, 1, 11.0)], "w int, p int, d double")
    assert frames.positional_join(a, a, ["w"], "p", "d").count() == 2
    for other in (a.where("p = 0"), a.withColumn("d", F.col("d") + 0.1)):
        with pytest.raises(PySparkException):
            frames.positional_join(a, other, ["w"], "p", "d").collect()


def test_trace_kernels():
    t = np.arange(256) * 0.004
    x = np.sin(2 * np.pi * 20 * t)[None, :]
    run = lambda name, **p: traces.Step(name, p).kernel(0.004)(x)
    inner = slice(40, -40)
    assert np.allclose(run("envelope")[0, inner], 1, atol=0.05)
    assert np.allclose(run("instantaneous_frequency")[0, inner], 20, atol=1.5)
    assert np.abs(run("phase_rotation", degrees=180.0) + x).max() < 1e-9
    high = np.sin(2 * np.pi * 100 * t)[None, :]
    mixed = x + high
    low = traces.Step("lowpass", {"f3": 40.0, "f4": 60.0}).kernel(0.004)(mixed)
    assert np.abs(low - x)[0, inner].max() < 0.1
    assert np.abs(traces.Step("highpass", {"f1": 40.0, "f2": 60.0}).kernel(0.004)(mixed) - high)[0, inner].max() < 0.1
    rms = np.sqrt((run("agc", window_ms=200.0)[0, inner] ** 2).mean())
    assert rms == pytest.approx(1, abs=0.05)
    with pytest.raises(ValueError):
        traces.Step("bandpass", {"f1": 10.0, "f2": 5.0, "f3": 60.0, "f4": 80.0}).check(0.004)


def test_pipeline_keeps_gaps_and_ragged_traces(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, None), (3, [2.0, 2.0, 2.0]), (4, [])], "id int, amplitude array<double>")
    got = {r["id"]: r["amplitude"] for r in traces.run_pipeline(df, [traces.Step("scale", {"factor": 2.0}), traces.Step("rms_normalise")], 4.0).collect()}
    assert got == {1: [1.0, -1.0], 2: None, 3: [1.0, 1.0, 1.0], 4: []}


def test_dip_of_a_dipping_event(spark):
    rows = []
    for il in range(5):
        for xl in range(5):
            t = np.arange(64) - 30 - il  # one sample later per inline
            rows.append((il, xl, np.exp(-(t**2) / 8.0).tolist()))
    df = spark.createDataFrame(rows, "il long, xl long, amplitude array<double>")
    d = {(r["il"], r["xl"]): r for r in neighborhood.dip(df, 4.0, neighborhood.Around(1, 1, 48.0)).collect()}
    assert d[2, 2]["inline_dip"][32] == pytest.approx(4.0, abs=0.3) and d[2, 2]["xline_dip"][32] == pytest.approx(0, abs=0.3)
    s = {(r["il"], r["xl"]): r["amplitude"] for r in neighborhood.similarity_expression(df, 4.0, neighborhood.Around(1, 1, 24.0)).collect()}
    f = {(r["il"], r["xl"]): r["amplitude"] for r in neighborhood.similarity(df, 4.0, neighborhood.Around(1, 1, 24.0), tile=2).collect()}
    assert s.keys() == f.keys() and all(np.allclose(s[k], f[k], atol=1e-6) for k in s)


@pytest.mark.parametrize("tile", [3, 32])
def test_dip_on_tiles_equals_the_walk(spark, tile):
    r = np.random.default_rng(2)
    cube = {(i, x): np.convolve(r.normal(size=40), np.hanning(7), "same") for i in range(-2, 5) for x in range(6) if (i + x) % 5}
    df = spark.createDataFrame([(i, x, a.tolist()) for (i, x), a in cube.items()] + [(9, 9, None)], "il long, xl long, amplitude array<double>")
    around = neighborhood.Around(1, 2, 36.0)
    half = around.half(4.0)
    got = {(row["il"], row["xl"]): row for row in neighborhood.dip(df, 4.0, around, tile=tile).collect()}
    assert got.keys() == cube.keys()
    for (i, x), a in cube.items():
        for t in range(0, 40, 3):
            lo, hi = max(0, t - half), min(40, t + half + 1)
            seen = []
            for di in range(-1, 2):
                for dx in range(-2, 3):
                    near = cube.get((i + di, x + dx))
                    hit = neighborhood.best_lag(a[lo:hi], lo, near, half) if near is not None and (di or dx) else None
                    if hit:
                        seen.append((di, dx, hit[0] * 4.0, hit[1]))
            want = neighborhood.fit_dip(seen)
            row = got[i, x]
            assert (row["inline_dip"][t], row["xline_dip"][t]) == pytest.approx(want, abs=1e-6)


def test_velocity_scan_finds_the_velocity(spark):
    rows = []
    for x in range(0, 2000, 100):
        a = np.zeros(128)
        at = np.sqrt(0.24**2 + (x / 2000.0) ** 2) / 0.004
        if at < 126:
            a[int(at)], a[int(at) + 1] = 1 - at % 1, at % 1
        rows.append((0, float(x), a.tolist()))
    df = spark.createDataFrame(rows, "gather int, offset double, amplitude array<double>")
    panel = gathers.semblance(df, 4.0, gathers.trial_velocities(1600, 2400, 100))
    best = panel.where("t = 60").orderBy(F.desc("semblance")).first()
    assert best["velocity"] == pytest.approx(2000, abs=100)
    assert gathers.trial_velocities(1000, 1950, 100)[-1] == 1950 and len(gathers.trial_velocities(1000, 1000, 5)) == 1
    flat = gathers.nmo(df, 4.0, 2000.0).where("offset < 400").collect()
    assert all(np.argmax(r["amplitude"]) in (59, 60, 61) for r in flat)


def test_time_depth(spark):
    assert time_depth.depth_trend([0.0, 10.0, 20.0], 0.0, 20.0, 2000.0, 1.0) == pytest.approx([2000.0, 2010.0, 2020.05])
    sources = spark.createDataFrame([(1, 7, 0, 0), (1, 8, 2, 2)], "survey int, source long, i long, x long")
    got = {(r.i, r.x): (r.source, r.distance_milli) for r in time_depth.assign_sources(sources, ["survey"], (3, 3), ((10.0, 0.0), (0.0, 10.0))).collect()}
    assert got[1, 1] == (7, 14142) and got[2, 1] == (8, 10000) and len(got) == 9
    sums = spark.range(1).select(time_depth.running_sums(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: i * 1.0)).alias("value"))
    assert values(sums)[0] == pytest.approx(np.cumsum(np.arange(1, 1001)))
    assert values(spark.range(1).select(time_depth.running_sums(F.array().cast("array<double>")).alias("value"))) == [[]]
    df = spark.createDataFrame([([100.0, 200.0], [50.0, 120.0]), ([100.0, 90.0], [50.0, 120.0])], "t array<double>, z array<double>")
    assert values(df.select(time_depth.pairs_rise(F.col("t"), F.col("z")).alias("value"))) == [True, False]
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [0.0, 10.0, 20.0]), (2, [5.0, 5.0, 5.0], None)], "id int, amplitude array<double>, depths array<double>")
    out = {r["id"]: r for r in time_depth.to_depth(rows, 4.0).collect()}
    assert out[1]["amplitude"] == pytest.approx([0, 1, 2]) and out[2]["amplitude"] == [0, 0, 0] and out[1]["depth_step"] == 10


def test_grid(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1.0, 0), (1000.0, 0.0, 2.0, 1), (1.0, 1.0, 3.0, 2)], "x double, y double, z double, n int")
    with pytest.raises(PySparkException, match="too few cells"):
        grid.import_horizon(pts, "n", (0, 0), (10, 0), (0, 10), 3, 3).collect()
    c = spark.createDataFrame([("a", 1, True, 10, 0.9, 100), ("b", 1, False, 90, 0.5, 100)], "label string, action int, automatic boolean, axis_count int, completeness double, cells int")
    assert [(r["label"], r["chosen"]) for r in grid.rank_geometries(c).collect()] == [("a", True), ("b", False)]
    g = grid.geometry(spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "il int, xl int"))
    assert g.first()["kind"] == "regular_sparse" and grid.storage_estimate(g, 10).first()["amplitude_bytes"] == 160


def test_marker_residual(spark):
    """A marker on a linear trajectory against a horizon between its rows."""
    stations = spark.createDataFrame([(1, 0.0, 0.0), (1, 100.0, 1060.0)], "well int, md double, tvd double")
    marker = spark.createDataFrame([(1, 50.0)], "well int, md double")
    depth = frames.bracket(marker, stations, ["well"], "md", "tvd").first()["tvd"]
    horizon = spark.createDataFrame([(1, 0.0, 520.0), (1, 10.0, 530.0)], "well int, y double, z double")
    level = frames.bracket(spark.createDataFrame([(1, 5.0)], "well int, y double"), horizon, ["well"], "y", "z").first()["z"]
    assert depth - level == pytest.approx(5)


def test_well_tie(spark):
    r = np.random.default_rng(3)
    synthetic = np.convolve(r.normal(size=90), np.hanning(9), "same")
    trace = np.roll(synthetic, 3)
    times = np.arange(90) * 4.0
    assert well_tie.shift_and_stretch(times, synthetic[None], trace[None], 5, 4.0)[0][0] == 3
    df = spark.createDataFrame([(1, synthetic.tolist(), trace.tolist())], "w int, synthetic array<double>, trace array<double>")
    assert well_tie.best_shift(df, ["w"], "synthetic", "trace", 5).first()["lag"] == 3
    kernel = np.zeros(17)
    kernel[6:11] = [0.2, 0.6, 1.0, 0.5, 0.1]
    spikes = r.normal(size=400)
    w = well_tie.wavelet(spikes, well_tie.convolve_same(spikes, kernel), 4.0, 100.0)
    mid = len(w) // 2
    assert np.allclose(w[mid - 2 : mid + 3], [0.2, 0.6, 1.0, 0.5, 0.1], atol=0.05)
    assert well_tie.wavelet(spikes[:10], spikes[:10], 4.0, 100.0) is None


def walked(cells, sources, bases):
    """Shortest paths by a queue over the whole grid."""
    si, sx, plus, minus = time_depth.step_costs(bases)
    moves = [(1, 0, si), (-1, 0, si), (0, 1, sx), (0, -1, sx), (1, 1, plus), (-1, -1, plus), (1, -1, minus), (-1, 1, minus)]
    best, queue = {}, []
    for s, i, x in sources:
        best[i, x] = (0, s)
        heapq.heappush(queue, (0, i, x, s))
    while queue:
        d, i, x, s = heapq.heappop(queue)
        if best[i, x] == (d, s):
            for a, b, c in moves:
                to = (i + a, x + b)
                if 0 <= to[0] < cells[0] and 0 <= to[1] < cells[1] and d + c < best.get(to, (1 << 62, 0))[0]:
                    best[to] = (d + c, s)
                    heapq.heappush(queue, (d + c, *to, s))
    return best


@pytest.mark.parametrize("bases", [((25.0, 0.0), (0.0, 12.5)), ((10.0, 0.0), (0.0, 10.0)), ((25.0, 5.0), (-5.0, 25.0)), ((20.0, 3.0), (7.0, 9.0))])
def test_nearest_sources_against_a_walk(bases):
    r = np.random.default_rng(7)
    for _ in range(40):
        cells = tuple(int(v) for v in r.integers(1, 14, 2))
        sources = sorted((int(s), int(r.integers(cells[0])), int(r.integers(cells[1]))) for s in r.permutation(int(r.integers(1, 7))))
        i, x = (m.ravel() for m in np.meshgrid(np.arange(cells[0]), np.arange(cells[1]), indexing="ij"))
        s, d = time_depth.nearest_sources(i, x, cells, np.array(sources), bases)
        assert {(a, b): (int(dd), int(ss)) for a, b, dd, ss in zip(i.tolist(), x.tolist(), d, s, strict=True)} == walked(cells, sources, bases)


def test_interval_stacks(spark):
    samples = spark.createDataFrame([(k, float(t)) for k in range(5) for t in (0, 5, 10, 15, 20)], "k int, t double")
    stacks = {0: [(1, 0.0, 10.0), (2, 10.0, 20.0)], 1: [(1, 0.0, 12.0), (2, 10.0, 20.0)], 2: [(1, 0.0, 9.0), (2, 10.0, 20.0)], 3: [(2, 0.0, 10.0), (1, 10.0, 20.0)]}
    intervals = spark.createDataFrame([(k, n, a, b, 1000.0 * n) for k, v in stacks.items() for n, a, b in v], "k int, number int, top double, base double, velocity double")
    got = {(r["k"], r["t"]): (r["velocity"], r["valid"]) for r in time_depth.merge_intervals(samples.union(samples), intervals, ["k"]).collect()}
    assert len(got) == 25
    assert [got[0, t] for t in (0, 5, 10, 15, 20)] == [(1000.0, True), (1000.0, True), (2000.0, True), (2000.0, True), (2000.0, True)]
    assert not got[1, 0][1]  # 10 lies in both
    assert got[2, 0] == (1000.0, True)  # no sample stands in the gap
    assert not got[3, 20][1] and not got[4, 0][1]  # only the last number's end is closed; no intervals at all
    bad = spark.createDataFrame([(0, 1, 5.0, 5.0, 1.0), (0, 2, 0.0, 20.0, 2.0)], "k int, number int, top double, base double, velocity double")
    assert not any(r["valid"] for r in time_depth.merge_intervals(samples.where("k = 0"), bad, ["k"]).collect())


def test_gates_keep_bad_samples_to_themselves(spark):
    x = np.random.default_rng(1).normal(size=(3, 3, 40))
    rows = [(i, j, x[i, j].tolist()) for i in range(3) for j in range(3)]
    around = neighborhood.Around(1, 1, 24.0)

    def run(rows_, work):
        df = spark.createDataFrame(rows_, "il int, xl int, amplitude array<double>")
        return {(r["il"], r["xl"]): r for r in work(df, 4.0, around).collect()}

    for work, name in ((neighborhood.similarity, "amplitude"), (neighborhood.local_statistics, "mean")):
        clean = run(rows, work)
        x[1, 1, 5] = np.nan
        spoilt = run([(i, j, x[i, j].tolist()) for i in range(3) for j in range(3)], work)
        x[1, 1, 5] = 1e15
        large = run([(i, j, x[i, j].tolist()) for i in range(3) for j in range(3)], work)
        for k in clean:
            for t in (0, *range(12, 40)):
                assert spoilt[k][name][t] == pytest.approx(clean[k][name][t], abs=1e-12) == large[k][name][t]
        x[1, 1, 5] = rows[4][2][5]


@pytest.mark.parametrize("refine", ["refine_linear", "refine_cubic"])
def test_refinement_of_a_grid_with_gaps(spark, refine):
    r = np.random.default_rng(2)
    n, m = 37, 35  # more than a tile
    traces_ = {(i, j): r.normal(size=3) for i in range(n) for j in range(m) if r.random() > 0.1 or (i, j) in ((0, 0), (n - 1, m - 1))}
    df = spark.createDataFrame([(i, j, v.tolist()) for (i, j), v in traces_.items()] + [(1, 1, None)], "il int, xl int, amplitude array<double>")
    got = {(t["il"], t["xl"]): t["amplitude"] for t in getattr(grid, refine)(df).collect()}

    def weights(k, last, cubic):
        b = k // 2
        if k % 2 == 0:
            return {b: 1.0}
        return {b - 1: -0.0625, b: 0.5625, b + 1: 0.5625, b + 2: -0.0625} if cubic else {b: 0.5, b + 1: 0.5}

    want = {}
    for i in range(2 * n - 1):
        for j in range(2 * m - 1):
            edge = (i % 2 and (i // 2 == 0 or i // 2 + 1 >= n - 1)) or (j % 2 and (j // 2 == 0 or j // 2 + 1 >= m - 1))
            cubic = refine == "refine_cubic" and not edge
            parts = [(a * b, traces_[p, q]) for p, a in weights(i, n - 1, cubic).items() for q, b in weights(j, m - 1, cubic).items() if (p, q) in traces_]
            if parts:
                want[i, j] = sum(w * v for w, v in parts)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_horizon_needs_most_of_its_points_mapped(spark):
    points = spark.range(100).selectExpr("cast(id % 10 as double) as x", "cast(floor(id / 10) as double) as y", "cast(id as double) as z", "id")
    unit = ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))
    assert grid.import_horizon(points, "id", *unit, 10, 10).count() == 100
    with pytest.raises(Exception, match="too few cells"):
        grid.import_horizon(points, "id", *unit, 10, 8).collect()
    assert grid.import_horizon(points, "id", *unit, 10, 8, check=False).count() == 80


def test_depth_windows_are_checked(spark):
    logs_ = spark.createDataFrame([(1, 0, 10.0), (1, 1, 11.0), (1, 2, 12.0), (2, 0, 30.0), (2, 1, 11.5), (2, 2, 9.0)], "w int, n int, d double")
    assert frames.depth_window(logs_, "d", 11.0, 12.0, ["w"], ["n"]).count() == 3
    for d in (float("nan"), None, 100.0):
        turned = logs_.union(spark.createDataFrame([(1, 3, d), (1, 4, 11.2)], "w int, n int, d double"))
        with pytest.raises(Exception, match="finite and run one way"):
            frames.depth_window(turned, "d", 11.0, 12.0, ["w"], ["n"]).collect()
    with pytest.raises(ValueError):
        frames.depth_window(logs_, "d", 11.0, float("nan"))
    assert [r["d"] for r in frames.trim_ends(logs_, ["w"], "d", 0.25).collect()] == [11.0]


def test_selectors(spark):
    df = spark.createDataFrame([("d t",), ("Density",), (None,)], "s string")
    bound = df.where("s = 'd t' or s is null").select(selectors.channel_binding("s", "vp").alias("value"))
    assert values(bound) == ["CompressionalSlowness", None]
    with pytest.raises(PySparkException, match="nothing for vp"):
        df.select(selectors.channel_binding("s", "vp")).collect()
    with pytest.raises(PySparkException, match="empty selector"):
        spark.createDataFrame([(" _ ",)], "s string").select(selectors.log_type("s")).collect()


def test_projection_of_a_known_point(spark):
    """A tower at 43.642567 N, 79.387139 W."""
    rows = spark.createDataFrame([(-79.387139, 43.642567)], "x double, y double")
    p = crs.reproject(rows, 4326, 32617).first()
    assert (p["x"], p["y"]) == pytest.approx((630084.301, 4833438.586), abs=0.001)
    south = crs.reproject(spark.createDataFrame([(18.4, -33.9)], "x double, y double"), 4326, 32734)
    assert 6_200_000 < south.first()["y"] < 6_300_000
    with pytest.raises(KeyError):
        crs.resolve("EPSG:28992")
    assert [r["code"] for r in crs.search(crs.catalogue(spark), "epsg:32631").collect()] == [32631]


def test_subvolumes_are_strict_parts(spark):
    df = spark.createDataFrame([(i, x, [1.0, 2.0, 3.0]) for i in (10, 12) for x in (5, 6)], "il int, xl int, amplitude array<double>")
    assert traces.subvolume(df, (10, 12), (5, 5), (0, 2)).count() == 2
    for il, xl, t in (((10, 12), (5, 6), (0, 2)), ((10, 11), (5, 6), (0, 1)), ((10, 12), (5, 6), (0, 3))):
        with pytest.raises(PySparkException, match="strict part"):
            traces.subvolume(df, il, xl, t).collect()
    with pytest.raises(ValueError):
        traces.subvolume(df, (12, 10), (5, 6), (0, 1))


def test_depth_trends_of_traces(spark):
    df = spark.createDataFrame([(1, 0.0, 20.0, 2000.0, 1.0), (2, 5.0, 12.0, 1500.0, 0.5), (3, None, 1.0, 1.0, 1.0)], "id int, top double, base double, v0 double, gradient double")
    got = {r["id"]: r["velocity"] for r in time_depth.depth_trend_traces(df, [0.0, 10.0, 20.0, 30.0]).collect()}
    assert got[3] is None
    for id_, args in ((1, (0.0, 20.0, 2000.0, 1.0)), (2, (5.0, 12.0, 1500.0, 0.5))):
        assert got[id_] == pytest.approx(time_depth.depth_trend([0.0, 10.0, 20.0, 30.0], *args))


@pytest.mark.parametrize("step", [0.5, 3.0, 40.0])
def test_centres_of_the_overlap_are_interpolated_in_every_channel(spark, step):
    r = np.random.default_rng(4)
    shared = np.round(r.uniform(0, 100, 12) * 4) / 4  # knots of several channels, and on centres
    logs_ = {(w, c): dict(zip(np.concatenate([r.uniform(0, 100, 20), shared[: 6 + c]]).tolist(), r.normal(size=26 + c).tolist(), strict=True)) for w in range(3) for c in range(3)}
    channels = {f"c{c}": spark.createDataFrame([(w, x, y) for w in range(3) for x, y in logs_[w, c].items()] + [(0, 5.0, None), (9, 1.0, 1.0)], "w int, x double, y double") for c in range(3)}
    got = {(t["w"], t["x"]): [t["c0"], t["c1"], t["c2"]] for t in frames.resample_aligned(channels, ["w"], "x", "y", step).collect()}
    want = {}
    for w in range(3):
        knots = [np.array(sorted(logs_[w, c].items())).T for c in range(3)]
        top, end = max(k[0][0] for k in knots), min(k[0][-1] for k in knots)
        for i in range(int((end - top) // step)):
            at = top + (i + 0.5) * step
            want[w, at] = [np.interp(at, *k) for k in knots]
    assert len(want) > 3 and got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_rounding_as_the_sql_does(spark):
    import duckdb

    from borespark.plans.workload import rounded

    values = [1038.9696564385, 693.9393617015, -693.9393617015, 63.1495703125, 0.5, -0.00000000049, 0.0, 1e300, float("nan"), None]
    values += [float(v) for v in np.round(np.random.default_rng(1).uniform(-6000, 6000, 3000), 10)]
    got = [t[0] for t in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(rounded(F.col("x"), 9)).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT CAST(0 AS DOUBLE) + ROUND(CAST(? AS DOUBLE), 9)", [v]).fetchone()[0] for v in values]
    assert [repr(v) for v in got] == [repr(v) for v in want]
