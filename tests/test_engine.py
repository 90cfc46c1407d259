"""Kernels against closed forms, forms of one query against each other, sources, sinks and programs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import healpix
from tessella.functions.polar import ARRAYS, PolarGrid
from tessella.functions.spline import bspline, sample, warp_to_image, warp_to_polar
from tessella.operators import correlate as C
from tessella.operators import decompose as D
from tessella.operators import energies as E
from tessella.operators import hypotheses as H
from tessella.operators import imaging as I
from tessella.operators import ledger as L
from tessella.plans import config as cfg
from tessella.plans import programs as P
from tessella.plans import search as S
from tessella.sources import mrc, store


def test_rectangles_and_runs():
    assert C.k_runs([(0, 0, 3, 3), (1, 3, 4, 2)]) == [(0, 1, [(0, 0, 3, 3)]), (1, 3, [(0, 0, 3, 3), (1, 3, 4, 2)]), (3, 5, [(1, 3, 4, 2)])]
    assert C.rectangles_disjoint([(0, 0, 3, 3), (1, 3, 4, 2)]) and not C.rectangles_disjoint([(0, 0, 3, 3), (2, 2, 1, 1)])
    with pytest.raises(ValueError):
        C.as_rectangle((0, 0, 0, 1))


def test_reduce_block_against_full_correlogram():
    rng = np.random.default_rng(1)
    for n_psi, k in ((16, 4), (6, 4)):
        y = rng.normal(size=(5, k, 3)) + 1j * rng.normal(size=(5, k, 3))
        w = rng.normal(size=(7, k, 3)) + 1j * rng.normal(size=(7, k, 3))
        got = C.reduce_block(y, w, n_psi, chunk=3)
        c = np.einsum("pkm,nkm->pnk", y, w.conj())
        c[..., 0].imag = 0
        if n_psi == 6:
            c[..., 3].imag = 0
        t = np.arange(n_psi)
        full = sum((1 if i in (0, n_psi // 2) else 2) * (c[..., i, None].real * np.cos(2 * np.pi * i * t / n_psi) - c[..., i, None].imag * np.sin(2 * np.pi * i * t / n_psi)) for i in range(k)).reshape(5, -1)
        np.testing.assert_allclose(got["mip"], full.max(1))
        np.testing.assert_allclose(got["mean"], full.mean(1), atol=1e-12)
        np.testing.assert_allclose(got["variance"], full.var(1))
        assert (got["best_virtual"] * n_psi + (n_psi - got["best_psi"]) % n_psi == full.argmax(1)).all()


def test_arrow_and_relational_forms_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(p, k, m, *map(float, rng.normal(size=2))) for p in range(6) for k in range(3) for m in range(2)]
    feats = spark.createDataFrame(rows, "p long, k int, m int, re double, im double")
    w = spark.createDataFrame([(n, k, m, *map(float, rng.normal(size=2))) for n in range(4) for k in range(3) for m in range(2)], "n long, k int, m int, re double, im double")
    a = C.search(feats, w, 8, 4).orderBy("p").toPandas()
    b = C.search_packed(C.pack(feats, 3, 2), C.weight_block(w, 3, 2), 8).orderBy("p").toPandas()
    for c in ("mip", "mean", "variance", "zscore", "best_virtual", "best_psi"):
        np.testing.assert_allclose(a[c], b[c], atol=1e-9)
    assert C.weight_block(w, 3, 2, limit=10) is None


def test_splines():
    x = np.linspace(-4, 4, 81)
    for order in range(1, 6):
        assert abs(sum(bspline(order, x[30] - i) for i in range(-9, 10)) - 1) < 1e-12
    r, c = np.indices((24, 24)).astype(float)
    image = np.exp(-((r - 11) ** 2 + (c - 13) ** 2) / 18)
    np.testing.assert_allclose(sample(image, r, c), image, atol=1e-9)
    at = r[4:-4, 4:-4] + 0.3, c[4:-4, 4:-4] - 0.4
    np.testing.assert_allclose(sample(image, *at), np.exp(-((at[0] - 11) ** 2 + (at[1] - 13) ** 2) / 18), atol=1e-4)


@pytest.mark.parametrize("kind", ["standard", "offset", "spiral"])
def test_polar_round_trips(kind):
    g = PolarGrid.of_image(kind, (32, 32), 16, 64)
    r, a = np.meshgrid(np.arange(1, 15, dtype=float), np.arange(64, dtype=float))
    rr, aa = g.to_polar(*g.to_image(r, a, ARRAYS), ARRAYS)
    keep = np.abs(rr - r) < 1e-6
    assert keep.all() and np.allclose((aa - a + 32) % 64 - 32, 0, atol=1e-6) or kind == "offset"
    assert abs(g.areas().sum() * 64 - math.pi * g.radius**2) / (math.pi * g.radius**2) < 0.1
    assert PolarGrid.from_dict(g.to_dict()) == g


def test_warp_and_back():
    g = PolarGrid.of_image("spiral", (32, 32), 32, 96)
    r, c = np.indices((32, 32)).astype(float)
    image = np.exp(-((r - 15) ** 2 + (c - 18) ** 2) / 12)
    back = warp_to_image(warp_to_polar(image, g), g)
    inside = np.hypot(r - 16, c - 16) < 13
    assert np.abs(back - image)[inside].max() < 0.02


def test_healpix():
    for nside in (1, 2, 4, 8):
        p = np.arange(12 * nside**2)
        t, ph = healpix.pix2ang(nside, p)
        assert (healpix.ang2pix(nside, t, ph) == p).all()
    t, ph = healpix.pix2ang(1, np.arange(12))
    np.testing.assert_allclose(np.cos(t), [2 / 3] * 4 + [0] * 4 + [-2 / 3] * 4, atol=1e-12)
    t, ph = healpix.pix2ang(4, np.arange(192))
    assert healpix.match_grid(np.degrees(t), np.degrees(ph))[0] == 4
    kids = healpix.ang2pix(2, t, ph)
    assert (kids == np.arange(192) // 4).all()  # nested: four children to a parent


def test_healpix_neighbors(spark):
    rows = healpix.neighbors(spark, 2).collect()
    pairs = {(r[0], r[1]) for r in rows}
    assert all((b, a) in pairs for a, b in pairs)
    counts = [sum(a == p for a, _ in pairs) for p in range(48)]
    assert set(counts) <= {6, 7, 8}


def test_projection_is_linear_and_keeps_the_sum():
    r = np.indices((16, 16, 16)).astype(float)
    v = np.exp(-((r[0] - 8) ** 2 + (r[1] - 7) ** 2 + (r[2] - 9) ** 2) / 6)
    p = D.project(*D.volume_spectrum(v), D.rotation_array(0, 0, 0))
    np.testing.assert_allclose(p, v.sum(0), atol=0.03 * v.sum(0).max())  # the correction for slicing between grid points acts on it too
    q = D.project(*D.volume_spectrum(v), D.rotation_array(30, 50, 0))
    assert abs(q.sum() - v.sum()) / v.sum() < 0.05


def test_svd_frobenius_and_reconstruction(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 6)) + 1j * rng.normal(size=(9, 6))
    rows = spark.createDataFrame([(n, 0, x[n].real.tolist(), x[n].imag.tolist()) for n in range(9)], "n long, k int, re array<double>, im array<double>")
    u, s, vh = (t.toPandas() for t in D.svd_per_frequency(rows, 6))
    assert abs((s["s"] ** 2).sum() - (abs(x) ** 2).sum()) < 1e-9
    U, V = np.zeros((9, 6), complex), np.zeros((6, 6), complex)
    U[u["n"], u["m"]] = u["re"] + 1j * u["im"]
    V[vh["m"], vh["r"]] = vh["re"] + 1j * vh["im"]
    np.testing.assert_allclose(U * s.sort_values("m")["s"].to_numpy() @ V, x, atol=1e-9)
    low = D.randomised_svd(x, 3)
    np.testing.assert_allclose(low[1], np.linalg.svd(x)[1][:3], rtol=1e-6)


def test_threshold_value():
    assert abs(L.zscore_threshold(65 * 65, 2 * 12 * 64) - 5.118) < 1e-3
    with pytest.raises(ValueError):
        L.zscore_threshold(0, 5)


def test_decisions_at_the_threshold_and_unknown(spark):
    z = spark.createDataFrame([(6.9,), (7.0,), (7.1,), (None,), (float("nan"),)], "z double")
    got = [r[0] for r in z.select(L.plain_label(F.col("z"), 7.0, accept=True)).collect()]
    assert got == [2, 1, 3, 1, 1]


def test_ids_out_of_range_fail(spark):
    with pytest.raises(Exception, match="outside"):
        H.sorted_unique_ids(spark.createDataFrame([(9,)], "id long"), 5).collect()


def test_mrc_masks_and_data_source(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 7)).astype(np.float32)
    (tmp_path / "a.mrc").write_bytes(mrc.encode_mrc(x, 1.5))
    row = mrc.read(spark, str(tmp_path / "a.mrc")).first()
    np.testing.assert_allclose(np.reshape(row["data"], (5, 7)), x - x.mean(), atol=1e-6)
    assert (row["image_id"], row["h"], row["w"]) == ("a", 5, 7) and abs(row["pixel_size"] - 1.5) < 1e-6
    spark.dataSource.register(mrc.MrcDataSource)
    assert spark.read.format("mrc").load(str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        mrc.volume(mrc.encode_mrc(np.zeros((2, 3, 3))))
    m = x > 0
    np.save(tmp_path / "m.npy", m)
    assert (mrc.decode_mask("m.npy", (tmp_path / "m.npy").read_bytes(), (5, 7)) == m).all()
    import gzip
    import struct
    import zlib

    def png(depth, rows):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    data = b"".join(b"\0" + bytes((r * 255).astype(np.uint8)) for r in m)
    assert (mrc.decode_mask("m.png", png(8, data)) == m).all()
    bits = b"".join(b"\0" + np.packbits(r).tobytes() for r in m)
    assert (mrc.decode_mask("m.png.gz", gzip.compress(png(1, bits))) == m).all()
    with pytest.raises(ValueError):
        mrc.decode_mask("m.png", png(8, data), (6, 6))


def test_store(spark, tmp_path):
    t = D.random_decomposition(spark, 6, 4, 5, 8)
    store.save_decomposition(spark, str(tmp_path / "d"), t["u"], t["s"], t["vh"], {"kind": "spiral"}, top=3)
    got = store.load_decomposition(spark, str(tmp_path / "d"))
    assert got["s"].count() == 3 and got["u"].count() == 18 and "volume" in got["u"].columns
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "d"), "whitening")
    with pytest.raises(ValueError):
        store.save_decomposition(spark, str(tmp_path / "e"), t["u"], t["s"], t["vh"], None)
    assert store.read_config(spark, str(tmp_path / "d"), "search") is None


def test_configs():
    c = cfg.CalibrateConfig.from_yaml("decomposition: a\noutput: b\nrectangles: [[0, 0, 2, 3]]\n")
    assert cfg.CalibrateConfig.from_yaml(c.to_yaml()) == c
    with pytest.raises(Exception, match="extra"):
        cfg.WhiteningConfig.from_yaml("images: a\noutput: b\nnothing: 1\n")
    with pytest.raises(ValueError):
        cfg.CalibrateConfig(decomposition="a", output="b")
    assert "<required>" in cfg.example("search")
    s = S.Stage(((0, 0, 3, 4),), 8, decision=S.Decision(5.0, calibration=None))
    assert S.Stage.from_json(s.to_json()) == s
    with pytest.raises(ValueError):
        S.Stage(((0, 0, 9, 1),), 8)


def test_streaming_equals_batch(spark, tmp_path):
    from tessella.streaming.arrivals import running_best, stream_files

    rows = [(i % 3, float((i * 7) % 11), i) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "k int, v double, id long").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    q = running_best(stream_files(spark, str(tmp_path / "in"), "k int, v double, id long"), "k", "v", "id").writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    want = running_best(spark.read.parquet(str(tmp_path / "in")), "k", "v", "id")
    assert sorted(spark.table("best").collect()) == sorted(want.collect())


def test_programs_end_to_end(spark, tmp_path):
    """A particle in noise is found at its place, and a second run has nothing left to search."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    rng = np.random.default_rng(7)
    z, y, x = np.indices((16, 16, 16)).astype(float)
    vol = sum(a * np.exp(-((z - p) ** 2 + (y - q) ** 2 + (x - r) ** 2) / 3) for a, p, q, r in ((1, 8, 5, 9), (1.4, 10, 10, 7), (0.8, 5, 8, 11)))
    (tmp_path / "v.mrc").write_bytes(mrc.encode_mrc(vol))
    P.run_decompose(spark, cfg.DecomposeConfig(volume=str(tmp_path / "v.mrc"), output=str(tmp_path / "dec"), polar=cfg.PolarGridConfig(num_radius=12, num_angle=32), eig_max=6))
    cal = P.run_calibrate(spark, cfg.CalibrateConfig(decomposition=str(tmp_path / "dec"), output=str(tmp_path / "cal"), rectangles=[(0, 0, 8, 6)], suggest=[cfg.SuggestTarget(max_components=40)]))
    assert 0 <= cal["summary"].first()["rho"] < 0.5 and cal["suggestion_0"].count() > 0
    ori = store.load(spark, str(tmp_path / "dec"), "decomposition")["orientations"].where("orientation = 3").first()
    particle = D.project(*D.volume_spectrum(vol), D.rotation_array(ori["phi_deg"], ori["theta_deg"], 0))
    particle = (particle - particle.mean()) / particle.std()
    (tmp_path / "mics").mkdir()
    for i in range(2):
        m = rng.normal(size=(36, 36))
        if i == 0:
            m[9:25, 6:22] += 1.5 * particle
        (tmp_path / "mics" / f"m{i}.mrc").write_bytes(mrc.encode_mrc(m))
    spectra = P.run_whitening(spark, cfg.WhiteningConfig(images=str(tmp_path / "mics"), output=str(tmp_path / "wh"), bins=16))
    assert spectra.select("image_id").distinct().count() == 2
    conf = cfg.SearchConfig(images=str(tmp_path / "mics"), decomposition=str(tmp_path / "dec"), output=str(tmp_path / "res"), stages=[
        cfg.StageConfig(rectangles=[(0, 0, 4, 4)], n_psi=32, decision=cfg.DecisionConfig(threshold=1.5, accept=False)),
        cfg.StageConfig(rectangles=[(0, 0, 8, 6)], n_psi=32, decision=cfg.DecisionConfig(threshold=2.0, reject=False, absorb_radius=2)),
    ])
    led = P.run_search(spark, conf)
    assert led.count() == 2 * 21 * 21
    best = led.where("image_id = 'm0' and last_stage = 1").orderBy(F.desc("mip")).first()
    assert (best["row"], best["col"]) == (9, 6) and best["orientation"] == 3 and best["label"] == L.LABELS["ACCEPTED"]
    again = S.unfinished(mrc.read(spark, str(tmp_path / "mics")), led)
    assert again.isEmpty()
    parts = P.run_export(spark, cfg.ExportConfig(result=str(tmp_path / "res"), output=str(tmp_path / "out"), radius=3))
    top = parts.where("image_id = 'm0'").orderBy(F.desc("mip")).first()
    assert math.hypot(top["pos_y"] - 9, top["pos_x"] - 6) <= 3 and top["pos_y_img"] == top["pos_y"] + 8


def test_energies_of_nothing(spark):
    empty = spark.createDataFrame([], "n long, energy double, angular_loss double, eigen_loss double")
    assert E.truncation_summary(empty).first()["rho"] == 0.0
    assert I.search_grid((8, 8), (8, 8)) == ((1, 1), (0, 0))
    with pytest.raises(ValueError):
        I.search_grid((4, 4), (8, 8))


def test_adjoint_of_the_warp():
    from tessella.functions.spline import WarpAdjoint

    rng = np.random.default_rng(0)
    g = PolarGrid.of_image("spiral", (16, 16), 14, 40)
    polar, image = rng.normal(size=(40, 14)), rng.normal(size=(16, 16))
    a = (warp_to_image(polar, g) * image).sum()
    b = (polar * WarpAdjoint(g).apply(image)).sum()
    assert abs(a - b) < 1e-8 * max(1, abs(a))


def test_errors_and_guards(spark):
    from tessella.operators import errors as R

    bins = I.radial_bins(spark, 8, 8, 6)
    spec = spark.createDataFrame([(0, ky, kx, float(ky + 1), float(kx)) for ky in range(8) for kx in range(5)], "n int, ky int, kx int, re double, im double")
    half = spec.withColumn("re", F.col("re") * 0.5).withColumn("im", F.col("im") * 0.5)
    prof = R.error_profiles(half, spec, spec, bins, ["n"]).toPandas()
    np.testing.assert_allclose(prof["rec_auto"], prof["res_auto"])
    np.testing.assert_allclose(prof["sig_rec"], 2 * prof["rec_auto"])
    got = R.summaries(R.residual_energy(spec, half, bins, ["n"])).collect()
    assert len(got) == 1 + 6 + 1 and all(abs(r["error"] - 0.5) < 1e-9 for r in got)
    assert R.check_bins(bins, 6).count() == 6
    f = spec.select("ky", "kx", F.col("re").alias("value"))
    assert R.check_filter(f, f).count() == 1
    with pytest.raises(Exception, match="another filter"):
        R.check_filter(f, f.withColumn("value", F.col("value") + 1)).collect()


def test_prepared_images(spark):
    from tessella.operators import micrograph as G

    rng = np.random.default_rng(0)
    rows = [(i, r, c, float(v)) for i in range(2) for (r, c), v in np.ndenumerate(rng.normal(size=(12, 12)))]
    px = spark.createDataFrame(rows, "image_id int, row int, col int, value double")
    images = I.image_rows(px, 12, 12)
    amp = I.amplitude_spectrum(I.spectra(images, 12, 12), 12, 12, 8)
    avg = I.whitening_curve(I.average_spectrum(amp).withColumn("image_id", F.lit(0)))
    cor = I.correction_curve(amp)
    out = G.whiten(images, G.image_filter(avg, cor, 12, 12, 8), 12, 12)
    stats = out.groupBy("image_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()
    assert len(stats) == 2 and all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in stats)
    planes = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 2.0, -0.1, 0.0)], "plane int, defocus double, astigmatism double, angle double")
    white = I.spectra(I.image_rows(out, 12, 12), 12, 12)
    cur = G.curves(white, I.ctf(I.rfft_grid(spark, 12, 12), planes, 1.5), cor, 12, 12, 8).toPandas()
    assert len(cur) == 2 * 2 * 8 and (cur[["noise", "signal"]] >= 0).all().all()
    lev = G.level_map(out, 3).groupBy("image_id").agg(F.avg("level").alias("m")).collect()
    assert all(abs(r["m"] - 1) < 1e-9 for r in lev)


def test_automatic_thresholds_are_those_of_each_image(spark):
    """An image's labels do not depend on the others of the run, and masked positions do not count."""
    rows = [("a", i, i, 0, False) for i in range(10)] + [("b", i, i, 0, i >= 10) for i in range(900)] + [("c", i, i, 0, False) for i in range(900)]

    class Flat(S.Searcher):
        def maps(self, pixels, stage):
            z = F.lit(2.5)
            return pixels.select("image_id", "pixel_id", z.alias("mip"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("variance"), z.alias("zscore"), F.lit(0).cast("long").alias("best_index"), F.lit(0).alias("best_psi"))

    def labels(rows):
        ledger = L.new_ledger(spark.createDataFrame(rows, "image_id string, pixel_id long, row int, col int, masked boolean"))
        out = Flat(None, [S.Stage(((0, 0, 1, 1),), 2)], 1, 1, None, lambda df, name: df.localCheckpoint()).run(ledger)
        assert out.columns == ledger.columns
        return {(r["image_id"], r["label"]) for r in out.where(F.col("label") != L.LABELS["MASKED"]).select("image_id", "label").distinct().collect()}

    assert L.zscore_threshold(20, 1) < 2.5 < L.zscore_threshold(1800, 1)
    yes, no = L.LABELS["ACCEPTED"], L.LABELS["REJECTED"]
    assert labels(rows) == {("a", yes), ("b", yes), ("c", no)} and labels(rows[:10]) == {("a", yes)}
