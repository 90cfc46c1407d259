"""The search's stages, kernels and programs against plain numpy and against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import adjoint, rings
from tessella.functions.polar import ArrayGrid, PolarGrid, get_transform
from tessella.functions.spline import warp_to_image, warp_to_polar
from tessella.operators import bands as B
from tessella.operators import correlate as C
from tessella.operators import decompose as D
from tessella.operators import imaging as I
from tessella.operators import ledger as L
from tessella.operators import prepared as P
from tessella.operators import tables as T
from tessella.plans import config as cfg
from tessella.plans import engine, planning
from tessella.plans import programs
from tessella.plans import search as S
from tessella.sources import mrc, store


def test_ring_kernels_are_the_queries(spark):
    rng = np.random.default_rng(0)
    for h, w in ((8, 8), (9, 7)):
        data = rng.normal(size=(h, w))
        px = spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in np.ndenumerate(data)], "image_id int, row int, col int, value double")
        amp = I.amplitude_spectrum(I.spectra(I.image_rows(px, h, w), h, w), h, w, 6)
        got = np.array([r["amplitude"] for r in amp.orderBy("f").collect()])
        np.testing.assert_allclose(rings.amplitude(data, rings.Rings(h, w, 6)), got, rtol=1e-9)
        curve = spark.createDataFrame([(0, f, float(f * f)) for f in range(6)], "image_id int, f int, curve double")
        grid = I.curve_to_grid(curve, h, w, 6).orderBy("ky", "kx").collect()
        np.testing.assert_allclose(rings.on_grid(np.arange(6.0) ** 2, h, w).ravel(), [r["value"] for r in grid], atol=1e-9)
        band = I.rfft_grid(spark, h, w).select("ky", "kx", I.band(F.col("radius"), 0.3, 0.2).alias("v")).orderBy("ky", "kx").collect()
        np.testing.assert_allclose(rings.band(h, w, 0.3, 0.2).ravel(), [r["v"] for r in band], atol=1e-12)
        planes = spark.createDataFrame([(0, 1.2, -0.1, 20.0)], "plane int, defocus double, astigmatism double, angle double")
        ctf = I.ctf(I.rfft_grid(spark, h, w), planes, 1.5).orderBy("ky", "kx").collect()
        # rows of the Nyquist frequency have one sign in either form; the squares are what the noise model takes
        np.testing.assert_allclose(P.ctf_planes(h, w, [(1.2, -0.1, 20.0)], P.Optics(1.5))[0].ravel(), [r["value"] for r in ctf], atol=1e-6)


def test_disk_means():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 9))
    for radius in (1, 2, 20):
        want = np.empty_like(x)
        for (r, c), _ in np.ndenumerate(x):
            at = [(i, j) for i in range(7) for j in range(9) if (i - r) ** 2 + (j - c) ** 2 <= radius**2]
            want[r, c] = np.mean([x[p] for p in at])
        np.testing.assert_allclose(rings.disk_mean(x, radius), want)


def test_features_in_every_form():
    rng = np.random.default_rng(0)
    g = PolarGrid.of_image("spiral", (12, 12), 9, 24)
    radial = rng.normal(size=(3, 2, 9)) + 1j * rng.normal(size=(3, 2, 9))
    radial[0] = radial[0].real
    index = tuple((k, m) for k in range(3) for m in range(2))
    kernels = engine.cell_kernels(radial, g, index)
    image = rng.normal(size=(20, 23))
    rows, cols = np.array([0, 3, 8, 8]), np.array([11, 0, 5, 2])
    planar = B.Cells(index, kernels)
    want = np.array([[(image[r : r + 12, c : c + 12] * k.conj()).sum() for k in kernels] for r, c in zip(rows, cols, strict=True)])
    np.testing.assert_allclose(B.features(image, rows, cols, planar, "direct"), want, atol=1e-9)
    np.testing.assert_allclose(B.features(image, rows, cols, planar, "fft"), want, atol=1e-9)
    np.testing.assert_allclose(B.features(image, rows, cols, B.Cells(index, kernels, adjoint.AdjointBases(g, radial)), "direct"), want, atol=1e-7)
    assert B.features(image, rows[:0], cols[:0], planar, "fft").shape == (0, 6)
    with pytest.raises(ValueError, match="leaves"):
        B.features(image, np.array([9]), np.array([0]), planar, "direct")
    with pytest.raises(ValueError, match="one length"):
        B.validate(rows, cols[:2], image.shape, (12, 12))
    assert B.region(np.array([2, 4]), np.array([1, 8]), (5, 5)) == ((2, 1), (3, 8), (8, 12))
    assert [B.fast_length(n) for n in (1, 7, 11, 17)] == [1, 8, 12, 18]


def test_contraction_is_chosen():
    g = PolarGrid.of_image("spiral", (12, 12), 9, 24)
    assert adjoint.box_contraction(g, 100) == "adjoint" and adjoint.box_contraction(g, 4) == "planar" and adjoint.box_contraction(g, 100, asked="planar") == "planar"
    with pytest.raises(ValueError):
        adjoint.box_contraction(ArrayGrid.from_transform(g), 100, asked="adjoint")
    assert "degree" in adjoint.unsupported_reason(g, 7) and adjoint.unsupported_reason(g) is None
    with pytest.raises(ValueError):
        adjoint.AdjointBases(g, np.zeros((3, 2, 8)))


def test_grids_from_arrays():
    rng = np.random.default_rng(0)
    g = PolarGrid.of_image("offset", (16, 16), 8, 32)
    a = get_transform("arrays", **ArrayGrid.from_transform(g).to_dict())
    x = rng.normal(size=(16, 16))
    np.testing.assert_allclose(warp_to_polar(x, a), warp_to_polar(x, g))
    p = warp_to_polar(x, g)
    np.testing.assert_allclose(warp_to_image(p, a), warp_to_image(p, g))
    with pytest.raises(ValueError):
        ArrayGrid(np.zeros((2, 3)), np.zeros((3, 2)), np.zeros((2, 2)), np.zeros((2, 2)), np.ones(3))
    s = PolarGrid.of_image("spiral", (16, 16), 8, 32)
    op = s.radial_continuation([0, 2, -2])
    np.testing.assert_allclose(op[2], op[1].conj())
    with pytest.raises(ValueError):
        s.radial_continuation([17])


def test_forms_know_the_sums_of_all_templates():
    rng = np.random.default_rng(2)
    for n_psi in (12, 6):
        w = rng.normal(size=(9, 4, 3)) + 1j * rng.normal(size=(9, 4, 3))
        y = rng.normal(size=(5, 4, 3)) + 1j * rng.normal(size=(5, 4, 3))
        want = C.reduce_block(y, w, n_psi, sums=True)
        s1, s2 = B.Forms(w, n_psi).sums(y)
        np.testing.assert_allclose(s1, want["s1"])
        np.testing.assert_allclose(s2, want["s2"])


def test_planning():
    stage = S.Stage(((0, 0, 4, 3), (4, 0, 2, 1)), 16, planes=(1, 0))
    plan = planning.plan_stage(stage, 3, 100, planning.Execution(broadcast=6 * 3 * 16 * 40))
    assert plan.planes == (0, 1) and plan.cells == 14 and plan.blocks == ((0, 40), (40, 80), (80, 100)) and plan.n_hypotheses == 200
    for bad in (S.Stage(((0, 0, 1, 1),), 4, planes=(3,)), S.Stage(((0, 0, 1, 1),), 4, planes=())):
        with pytest.raises(ValueError):
            planning.plan_stage(bad, 3, 10)
    with pytest.raises(ValueError):
        planning.plan_stage(stage, 3, 0)
    with pytest.raises(ValueError):
        planning.execution_config({"nothing": 1})
    with pytest.raises(ValueError):
        planning.execution_config({"precision": "fp16"})
    assert planning.execution_config({"mode": "fft"}).mode == "fft" and planning.execution_config(None) == planning.Execution()
    assert planning.plan_bands((100, 50), 10, planning.Execution(features=50 * 10 * 16 * 7)) == 7
    m = planning.plan_memory(10, 5, 64, 1000, planning.Execution(spectrum=1 << 20))
    assert m.templates <= 256 and m.pixels * m.templates * (16 * 5 + 8 * 64 + 16) <= 1 << 20
    assert planning.choose_mode(10000, 100, (200, 200), (50, 50)) == "direct" and planning.choose_mode(10000, 5000, (200, 200), (50, 50)) == "fft" and planning.choose_mode(10, 10, (60, 60), (50, 50)) == "direct"
    assert planning.feature_bytes_per_pixel([((0, 0, 2, 3), "fp64", 2)]) == 2 * 6 * 16
    sizes = {"n_planes": 1, "cells": 20, "n_freq": 5, "n_psi": 32}
    assert planning.choose_tile([1] * 50, width=4, **sizes) == 8
    assert planning.choose_tile([512] * 4, width=1000, **sizes) >= planning.choose_tile([3] * 4, width=1000, **sizes)


def test_thresholds_as_a_column(spark):
    n = [2, 3, 20, 100, 1e4, 1e8, 3e10, 1e12]
    got = spark.createDataFrame([(float(x),) for x in n], "n double").select("n", L.threshold_column(F.col("n")).alias("t")).collect()
    for r in got:
        assert r["t"] == pytest.approx(L.zscore_threshold(1, int(r["n"])), abs=2e-4 if r["n"] > 1e11 else 1e-6)
    s = S.Searcher(None, [S.Stage(((0, 0, 1, 1),), 2), S.Stage(((0, 0, 1, 1),), 2)], 1, 1, None, None)
    other = s.with_thresholds([None, 4])
    assert other.stages[0].decision.threshold == "auto" and other.stages[1].decision.threshold == 4.0
    with pytest.raises(ValueError):
        s.with_thresholds([1.0])


def test_a_particle_far_from_its_pixels_is_picked(spark):
    """The nearest peak owns an accepted pixel whatever the distance."""
    rows = [("a", i, 0, i, L.LABELS["ACCEPTED"] if i == 0 else L.LABELS["AMBIGUOUS"], 5.0 + i * 0.1) for i in range(40)]
    rows += [("a", 4000, 90, 90, L.LABELS["AMBIGUOUS"], 3.0), ("b", 1, 0, 0, L.LABELS["AMBIGUOUS"], 9.0)]
    led = spark.createDataFrame(rows, "image_id string, pixel_id long, row int, col int, label int, zscore double")
    assert [r["pixel_id"] for r in L.pick_particles(led, 2.0).collect()] == [39]


def test_sets_are_replaced_when_written_whole(spark, tmp_path):
    path = str(tmp_path / "set")
    ids = spark.createDataFrame([("001", 1), ("02", 2)], "image_id string, v int")
    store.save(spark, path, "result", {"ledger": ids}, {"a": 1}, "search")
    before = store.load(spark, path, "result")["ledger"]
    assert dict(before.dtypes)["image_id"] == "string" and {r["image_id"] for r in before.collect()} == {"001", "02"}
    # what a run that died has left does not count
    ids.write.parquet(f"{path}/tables-1-dead/ledger")
    assert store.load(spark, path, "result")["ledger"].count() == 2
    store.save(spark, path, "result", {"ledger": before.unionByName(ids.limit(1))}, {"a": 2}, "search")
    assert store.load(spark, path, "result")["ledger"].count() == 3 and store.read_attr(spark, path, "a") == 2 and store.read_attr(spark, path, "b") is None
    assert sorted(p.name[:8] for p in (tmp_path / "set").iterdir()) == ["meta", "tables-1"]


def scene(tmp_path):
    """A generator of noise, and a volume that is written, beside a folder for images."""
    rng = np.random.default_rng(7)
    z, y, x = np.indices((16, 16, 16)).astype(float)
    f = np.fft.fftfreq(16)
    blur = np.exp(-2 * np.pi**2 * (f[:, None, None] ** 2 + f[None, :, None] ** 2 + f[None, None, :] ** 2))
    noise = np.random.default_rng(3).normal(size=(16, 16, 16))  # projections of a blurred one differ enough to tell poses
    vol = np.fft.ifftn(np.fft.fftn(noise) * blur).real * ((z - 8) ** 2 + (y - 8) ** 2 + (x - 8) ** 2 <= 36)
    (tmp_path / "v.mrc").write_bytes(mrc.encode_mrc(vol))
    (tmp_path / "mics").mkdir()
    return rng, vol


def test_noise_tables_split_each_template(spark, tmp_path):
    scene(tmp_path)
    out = str(tmp_path / "dec")
    programs.run_decompose(spark, cfg.DecomposeConfig(volume=str(tmp_path / "v.mrc"), output=out, polar=cfg.PolarGridConfig(num_radius=12, num_angle=32), eig_max=6))
    rects, more = [(0, 0, 4, 3)], [(0, 0, 12, 6)]
    got = programs.run_calibrate(spark, cfg.CalibrateConfig(decomposition=out, output=str(tmp_path / "cal"), noise_tables=[rects, more], bins=8))["error_tables"]
    rows = got.toPandas()
    assert len(rows) == 2 * 12 * 8
    np.testing.assert_allclose(rows["rec_auto"] + 2 * rows["rec_res"] + rows["res_auto"], rows["template"], rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(rows["sig_rec"] + rows["sig_res"], rows["template"], rtol=1e-6, atol=1e-8)  # without whitening the signal is the template
    total = T.exact_errors(got).where("n is null and f is null").collect()
    few, many = (T.exact_errors(store.error_table(spark, str(tmp_path / "cal"), T.tag_of(r))).where("n is null and f is null").first()["error"] for r in (rects, more))
    assert len(total) == 1 and 0 < many < few < 1
    with pytest.raises(ValueError, match="no error table"):
        store.error_table(spark, str(tmp_path / "cal"), T.tag_of([(0, 0, 1, 1)]))
    with pytest.raises(ValueError, match="leaves"):
        T.cells_of([(0, 0, 40, 2)], 17, 6)
    meta = {"grid": 1, "box": 2, "filter": None}
    T.check_table(meta, meta, 3, 3)
    for other, n in ((meta | {"box": 3}, 3), (meta, 4)):
        with pytest.raises(ValueError):
            T.check_table(meta, other, n, 3)


def test_templates_are_reconstructed_as_images(spark, tmp_path):
    """All cells give the projection back, few of them less of it; a turn in the plane is a turn of the image."""
    _, vol = scene(tmp_path)
    out = str(tmp_path / "dec")
    programs.run_decompose(spark, cfg.DecomposeConfig(volume=str(tmp_path / "v.mrc"), output=out, polar=cfg.PolarGridConfig(num_radius=14, num_angle=40), eig_max=8, k_max=10))
    t, meta = store.load_decomposition(spark, out), store.read_meta(spark, out)["config"]
    grid = PolarGrid.from_dict(meta["grid"])
    k_max, eig_max = (r + 1 for r in t["s"].agg(F.max("k"), F.max("m")).first())
    w = C.weights_of(t["u"].select("n", "k", "m", "re", "im"), t["s"]).cache()
    ori = t["orientations"].where("orientation = 4").first()
    want = D.project(*D.volume_spectrum(vol), D.rotation_array(ori["phi_deg"], ori["theta_deg"], 0))
    want = (want - want.mean()) / np.sqrt(want.var(ddof=1) + 1e-8)
    mask = T.support(grid)
    queries = spark.createDataFrame([(0, 4, 0.0), (1, 4, math.pi)], "q long, n long, psi double")

    def images(rect):
        cells = T.cells_of([rect], k_max, eig_max)
        kern = engine.cell_kernels(engine.radial_vectors(t["vh"], grid, k_max, eig_max), grid, cells)
        return {r["q"]: np.array(r["data"]).reshape(16, 16) for r in T.reconstruct_images(queries, w, kern, cells, grid.num_angle).collect()}

    lost = lambda x: np.linalg.norm((x - want)[mask]) / np.linalg.norm(want[mask])
    full, few = images((0, 0, k_max, eig_max)), images((0, 0, 4, 2))
    assert lost(full[0]) < 0.3 < lost(few[0]) < 1
    turned = np.roll(full[0][::-1, ::-1], (1, 1), (0, 1))  # half a turn about the center pixel
    inner = np.hypot(*(np.indices((16, 16)) - 8)) <= 6
    assert np.corrcoef(full[1][inner], turned[inner])[0, 1] > 0.98


def test_incomplete_bands_are_refused(spark):
    images = spark.createDataFrame([("a", 8, 8, [0.0] * 64)], "image_id string, h int, w int, data array<double>")
    bands = B.plane_bands(images, None, P.Optics(), (3, 3), 4)
    B.check_complete(bands, images, 1, 6, 4)
    for bad in (bands.where("band = 0"), bands.union(bands)):
        with pytest.raises(ValueError, match="instead of 2"):
            B.check_complete(bad, images, 1, 6, 4)
    assert C.covered_k([(0, 0, 2, 1), (4, 0, 1, 1)]) == [0, 1, 4]


def test_support_covers_the_rings():
    g = PolarGrid.of_image("spiral", (20, 20), 14, 40)
    mask = T.support(g)
    r, c = np.indices((20, 20)) - 10
    assert mask[np.hypot(r, c) <= 7].all() and not mask[np.hypot(r, c) > 10.5].any()
    assert 7 <= T.support_radius(mask) <= 10


def test_prepared_images_are_checked_and_kept(spark, tmp_path):
    rng, _ = scene(tmp_path)
    for i in range(2):
        (tmp_path / "mics" / f"m{i}.mrc").write_bytes(mrc.encode_mrc(rng.normal(size=(24, 30)) * (1 + i)))
    images = mrc.read(spark, str(tmp_path / "mics"))
    spectra = programs.run_whitening(spark, cfg.WhiteningConfig(images=str(tmp_path / "mics"), output=str(tmp_path / "wh"), bins=16))
    planes = images.select("image_id", F.expr("array(named_struct('defocus', 1.0D, 'astigmatism', 0.0D, 'angle', 0.0D), named_struct('defocus', 1.5D, 'astigmatism', 0.1D, 'angle', 30.0D))").alias("planes"))
    ready = P.prepare(images, spectra, planes, P.Optics(1.5), radius=3)
    P.save(spark, str(tmp_path / "prep"), ready, {"x": 1})
    got = P.load(spark, str(tmp_path / "prep"), {"x": 1}).toPandas()
    assert P.load(spark, str(tmp_path / "prep"), {"x": 2}) is None and P.load(spark, str(tmp_path / "none")) is None
    for r in got.itertuples():
        x = np.asarray(r.data)
        assert abs(x.mean()) < 1e-5 and abs(x.std(ddof=1) - 1) < 1e-5 and abs(np.mean(r.level) - 1) < 1e-5 and len(r.noise) == 2 and len(r.noise[0]) == 16
    curves = P.curve_table(ready, 16)
    assert curves.count() == 2 * 2 * 16 and P.level_table(ready).count() == 2 * 24 * 30
    # the relational form of the whitening
    from tessella.operators import micrograph as G

    avg, cor = I.whitening_curve(I.average_spectrum(spectra).withColumn("image_id", F.lit(0))), I.correction_curve(spectra)
    white = G.whiten(images, G.image_filter(avg, cor, 24, 30, 16), 24, 30).where("image_id = 'm0'").orderBy("row", "col").collect()
    np.testing.assert_allclose([r["value"] for r in white], got.set_index("image_id").loc["m0"].data, atol=1e-4)
    with pytest.raises(Exception, match="away from the recorded"):
        P.prepare(images.withColumn("data", F.transform("data", lambda v: v * v)), spectra, planes, P.Optics()).collect()
    with pytest.raises(Exception, match="no spectrum"):
        P.prepare(images, spectra.where("image_id = 'm0'"), planes, P.Optics()).collect()


def test_stages_by_bands_are_the_plain_search(spark, tmp_path):
    """Whole stages, levels, blocks of templates and local stages against numpy over all templates."""
    rng, vol = scene(tmp_path)
    out = str(tmp_path / "dec")
    programs.run_decompose(spark, cfg.DecomposeConfig(volume=str(tmp_path / "v.mrc"), output=out, nside=2, polar=cfg.PolarGridConfig(num_radius=12, num_angle=32), eig_max=4))
    t, meta = store.load_decomposition(spark, out), store.read_meta(spark, out)["config"]
    grid = PolarGrid.from_dict(meta["grid"])
    images = spark.createDataFrame([(f"i{i}", 24, 22, rng.normal(size=24 * 22).tolist()) for i in range(2)], "image_id string, h int, w int, data array<double>")
    w = C.weights_of(t["u"].select("n", "k", "m", "re", "im"), t["s"]).cache()
    bands = B.plane_bands(images, None, P.Optics(), (16, 16), 4).cache()
    assert bands.count() == 2 * 3

    def work(**limits):
        return engine.Engine(bands, 4, (24, 22), (9, 7), grid, t["vh"], w, t["orientations"], 2, 1, 1, 48, (17, 4), lambda df, name: df.cache(), planning.Execution(**limits))

    px = programs.positions(images.select("image_id"), 9, 7, None, (16, 16)).withColumn("best_index", (F.col("pixel_id") % 48).cast("long"))
    block = C.weight_block(w, 5, 3)
    radial = engine.radial_vectors(t["vh"], grid, 5, 3)
    kern = engine.cell_kernels(radial, grid, [(k, m) for k in range(5) for m in range(3)])
    feats = {}
    for r in images.collect():
        x = np.array(r["data"]).reshape(24, 22).astype(np.float32).astype(float)
        at = np.indices((9, 7)).reshape(2, -1)
        feats[r["image_id"]] = B.features(x, at[0], at[1], B.Cells(tuple((k, m) for k in range(5) for m in range(3)), kern), "direct").reshape(-1, 5, 3)
    stage = S.Stage(((0, 0, 5, 3),), 16)
    assert work().plan(stage).n_templates == 48

    def same(got, rows):
        for name, y in feats.items():
            want = C.reduce_block(y, block[rows], 16)
            mine = got[got["image_id"] == name].sort_values("pixel_id")
            np.testing.assert_array_equal(mine["best_index"], np.asarray(rows)[want["best_virtual"]])
            for c in ("mip", "mean", "variance", "zscore", "best_psi"):
                np.testing.assert_allclose(mine[c], want[c], rtol=1e-6, atol=1e-8)

    everything = list(range(48))
    same(work().maps(px, stage).toPandas(), everything)
    blocks = work(broadcast=5 * 3 * 16 * 20, features=16 * 15 * 5, spectrum=4096, mode="fft", contraction="planar")
    assert len(blocks.plan(stage).blocks) == 3
    blocks.cells = work().cells  # whose own limit follows that of the blocks
    same(blocks.maps(px, stage).toPandas(), everything)
    same(work().maps(px, S.Stage(((0, 0, 5, 3),), 16, level=1)).toPandas(), [i for i in everything if i % 4 == 0])
    same(work().maps(px, S.Stage(((0, 0, 5, 3),), 16, orientations=(5, 3))).toPandas(), [3, 5])
    with pytest.raises(ValueError, match="no level"):
        work().maps(px, S.Stage(((0, 0, 5, 3),), 16, level=2))
    # a local stage: the best of the seed's cell, the moments of all
    e = work()
    e.base = 1
    local = S.Stage(((0, 0, 5, 3),), 16, rings=1)
    near = e.neighborhoods(local)
    assert sorted(near) == list(range(12)) and all(set(range(4 * c, 4 * c + 4)) <= set(n) for c, n in near.items())
    got = e.maps(px, local).toPandas()
    for name, y in feats.items():
        whole = C.reduce_block(y, block, 16)
        for r in got[got["image_id"] == name].itertuples():
            members = near[(r.pixel_id % 48) // 4]
            want = C.reduce_block(y[r.pixel_id : r.pixel_id + 1], block[members], 16)
            assert r.best_index == members[want["best_virtual"][0]] and r.mip == pytest.approx(want["mip"][0])
            assert r.mean == pytest.approx(whole["mean"][r.pixel_id]) and r.variance == pytest.approx(whole["variance"][r.pixel_id])
    with pytest.raises(Exception, match="no seed"):
        work().maps(px.withColumn("best_index", F.when(F.col("pixel_id") != 5, F.col("best_index"))), local).collect()
    with pytest.raises(ValueError, match="finer level"):
        work().maps(px, S.Stage(((0, 0, 5, 3),), 16, level=1, rings=1))


def test_noise_model_search_end_to_end(spark, tmp_path):
    """Whitening, decomposition, tables, a coarse calibrated stage that accepts nothing, a full one and a local one."""
    rng, vol = scene(tmp_path)
    ids = [f"{i:03d}" for i in range(3)]
    for i, name in enumerate(ids):  # first only noise, so that the whitening and the filter are known
        (tmp_path / "mics" / f"{name}.mrc").write_bytes(mrc.encode_mrc(rng.normal(size=(40, 40))))
    where = {k: str(tmp_path / k) for k in ("wh", "dec", "cal", "res", "prep", "out", "mics")}
    programs.run_whitening(spark, cfg.WhiteningConfig(images=where["mics"], output=where["wh"], bins=16))
    programs.run_decompose(spark, cfg.DecomposeConfig(volume=str(tmp_path / "v.mrc"), output=where["dec"], polar=cfg.PolarGridConfig(num_radius=12, num_angle=32), eig_max=6, whitening=where["wh"]))
    meta = store.read_meta(spark, where["dec"])["config"]
    ori = store.table(spark, where["dec"], "orientations").where("orientation = 3").first()
    particle = D.project(*D.volume_spectrum(vol), D.rotation_array(ori["phi_deg"], ori["theta_deg"], 0))
    particle = (particle - particle.mean()) / particle.std()
    m = rng.normal(size=(40, 40))
    m[9:25, 6:22] += 2.0 * particle
    (tmp_path / "mics" / "000.mrc").write_bytes(mrc.encode_mrc(m))
    # the filter that the decomposition records is not that of the new images
    programs.run_whitening(spark, cfg.WhiteningConfig(images=where["mics"], output=where["wh"], bins=16))
    coarse, full = [(0, 0, 4, 3)], [(0, 0, 10, 6)]
    decision = cfg.DecisionConfig(accept=False, calibration=cfg.CalibrationConfig(alpha=0.05))
    stages = [cfg.StageConfig(rectangles=coarse, n_psi=32, decision=decision), cfg.StageConfig(rectangles=full, n_psi=32, decision=cfg.DecisionConfig(reject=False)), cfg.StageConfig(rectangles=full, n_psi=64, rings=1, decision=cfg.DecisionConfig(reject=False, absorb_radius=3))]
    conf = cfg.SearchConfig(images=where["mics"], decomposition=where["dec"], output=where["res"], whitening=where["wh"], error_tables=where["cal"], prepared=where["prep"], stages=stages)
    programs.run_calibrate(spark, cfg.CalibrateConfig(decomposition=where["dec"], output=where["cal"], noise_tables=[coarse]))
    with pytest.raises(ValueError, match="another filter"):
        programs.run_search(spark, conf)
    programs.run_decompose(spark, cfg.DecomposeConfig(volume=str(tmp_path / "v.mrc"), output=where["dec"], polar=cfg.PolarGridConfig(num_radius=12, num_angle=32), eig_max=6, whitening=where["wh"]))
    with pytest.raises(ValueError, match="another filter"):
        programs.run_search(spark, conf)  # the tables are of the former one
    programs.run_calibrate(spark, cfg.CalibrateConfig(decomposition=where["dec"], output=where["cal"], noise_tables=[coarse]))
    led = programs.run_search(spark, conf)
    assert led.count() == 3 * 25 * 25 and {r["image_id"] for r in led.select("image_id").distinct().collect()} == set(ids)
    best = led.where("label = 3").orderBy(F.desc("mip")).first()
    assert (best["image_id"], best["row"], best["col"], best["orientation"]) == ("000", 9, 6, 3)
    first = led.where("last_stage = 0")
    assert first.where("score is null").isEmpty() and first.where(f"label = {L.LABELS['ACCEPTED']}").isEmpty()
    rejected = led.where(f"label = {L.LABELS['REJECTED']}")
    assert not rejected.isEmpty() and rejected.where("last_stage <> 0").isEmpty()
    result = store.load_result(spark, where["res"])
    by_stage = {r["stage"]: r["count"] for r in result["stage_results"].groupBy("stage").count().collect()}
    assert by_stage[0] == 3 * 625 and by_stage[1] == 3 * 625 - rejected.count() and by_stage[2] <= by_stage[1]
    assert P.load(spark, where["prep"]).count() == 3
    assert programs.run_search(spark, conf).count() == led.count()  # nothing is left to do
    parts = programs.run_export(spark, cfg.ExportConfig(result=where["res"], output=where["out"], radius=3, optics={"label": "group1"}))
    top = parts.orderBy(F.desc("mip")).first()
    assert math.hypot(top["pos_y"] - 9, top["pos_x"] - 6) <= 3 and top["total_correlations"] == 12 * 64 and top["optics_label"] == "group1" and top["voltage"] == 300.0
    assert sorted(r["particle_index"] for r in parts.collect()) == list(range(parts.count()))
    assert spark.read.parquet(where["res"] + "/maps").count() == 3 * 625


def test_settings_that_cannot_be_followed_are_refused():
    stage = {"rectangles": [(0, 0, 2, 2)], "n_psi": 8}
    base = {"images": "a", "decomposition": "b", "output": "c"}
    with pytest.raises(ValueError, match="whitening and error_tables"):
        cfg.SearchConfig(**base, stages=[stage | {"decision": {"calibration": {}}}])
    with pytest.raises(ValueError, match="no seeds"):
        cfg.SearchConfig(**base, stages=[stage | {"rings": 1}])
    s = S.Searcher(None, [], 1, 1, None, None)
    with pytest.raises(ValueError, match="which templates"):
        s.maps(None, S.Stage(((0, 0, 1, 1),), 2, level=1))
    with pytest.raises(ValueError, match="neighborhoods"):
        s.maps(None, S.Stage(((0, 0, 1, 1),), 2, rings=1))


def test_images_have_their_own_planes(spark):
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    base = {"images": "a", "decomposition": "b", "output": "c", "stages": [], "defocus": [-0.1, 0.1]}
    got = {r["image_id"]: r["planes"] for r in programs.plane_table(images, cfg.SearchConfig(**base, micrographs={"a": cfg.MicrographConfig(defocus_u=1.2, defocus_v=1.0, astigmatism_angle=30), "b": cfg.MicrographConfig(defocus_u=2, defocus_v=2)})).collect()}
    assert [round(p["defocus"], 6) for p in got["a"]] == [1.0, 1.2] and round(got["a"][0]["astigmatism"], 6) == 0.1 and got["b"][1]["angle"] == 0.0
    assert programs.plane_table(images, cfg.SearchConfig(**(base | {"defocus": [0.0]}))) is None
    with pytest.raises(Exception, match="no entry"):
        programs.plane_table(images, cfg.SearchConfig(**base, micrographs={"a": cfg.MicrographConfig(defocus_u=1, defocus_v=1)})).collect()
