"""The five programs: whitening, decompose, calibrate, search, export. Each reads and writes sets of tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import healpix, rings
from tessella.functions.polar import PolarGrid
from tessella.operators import bands as B
from tessella.operators import correlate as C
from tessella.operators import decompose as D
from tessella.operators import energies as E
from tessella.operators import imaging as I
from tessella.operators import ledger as L
from tessella.operators import prepared, tables
from tessella.operators import threshold as T
from tessella.plans import config as cfg
from tessella.plans import engine, planning
from tessella.plans import search as S
from tessella.sources import mrc, store


def image_shape(images: DataFrame) -> tuple[int, int]:
    shapes = images.select("h", "w").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("a run takes images of one size")
    return shapes[0]["h"], shapes[0]["w"]


def run_whitening(spark: SparkSession, config: cfg.WhiteningConfig) -> DataFrame:
    """(image_id, f, freq, amplitude) of all images."""
    images = mrc.read(spark, config.images)
    h, w = image_shape(images)
    spectra = I.amplitude_spectrum(I.spectra(images, h, w), h, w, config.bins)
    store.save(spark, config.output, "whitening", {"spectra": spectra}, config.model_dump(mode="json"), "whitening")
    return store.load(spark, config.output, "whitening")["spectra"]


def whitening_filter(spark: SparkSession, path: str | None) -> dict | None:
    """The average curve and the band of a whitening set, as a decomposition records them; None without one."""
    if path is None:
        return None
    tables, c = store.load(spark, path, "whitening"), store.read_meta(spark, path)["config"]
    return {"average": prepared.average_curve(tables["spectra"], c["max_freq"]).round(12).tolist(), "cutoff": c["band_cutoff"], "falloff": c["band_falloff"], "max_freq": c["max_freq"]}


def check_template_filter(recorded: dict | None, now: dict | None) -> None:
    """Refuse a decomposition that was made under another filter than the whitening's."""
    same = (recorded is None) == (now is None)
    if same and now is not None:
        same = len(recorded["average"]) == len(now["average"]) and np.allclose(recorded["average"], now["average"], rtol=1e-4, atol=1e-6) and all(recorded[k] == now[k] for k in ("cutoff", "falloff"))
    if not same:
        raise ValueError("the decomposition was made under another filter than this whitening's")


def box_filter(recorded: dict | None, box: tuple[int, int]) -> np.ndarray | None:
    return None if recorded is None else prepared.template_filter(np.array(recorded["average"]), *box, recorded["cutoff"], recorded["falloff"])


def run_decompose(spark: SparkSession, config: cfg.DecomposeConfig) -> dict[str, DataFrame]:
    volume = mrc.read_volume(spark, config.volume)
    d = volume.shape[0]
    grid = PolarGrid.of_image(config.polar.kind, (d, d), config.polar.num_radius, config.polar.num_angle)
    orient = healpix.orientations(spark, config.nside)
    recorded = whitening_filter(spark, config.whitening)
    bank = None if recorded is None else box_filter(recorded, (d, d))[None]
    spectra = D.polar_spectra(D.projections(orient, volume, config.pad), grid, bank, normalise=config.normalize_projections)
    u, s, vh = D.svd_per_frequency(spectra, config.eig_max, config.k_max, config.low_rank)
    meta = {"grid": grid.to_dict(), "box": d, "sparse": False, "filter": recorded, **config.model_dump(mode="json")}
    store.save(spark, config.output, "decomposition", {"u": u, "s": s, "vh": vh, "orientations": orient, "blocks": D.block_energies(spectra, grid.num_angle)}, meta, "decompose")
    return store.load_decomposition(spark, config.output)


def noise_tables(spark: SparkSession, t: dict[str, DataFrame], meta: dict, rectangles: list, bins: int) -> DataFrame:
    """(tag, n, f, freq, profiles.., template) of each set of rectangles, over all template rows."""
    grid = PolarGrid.from_dict(meta["grid"])
    box = (grid.height, grid.width)
    k_max, eig_max = (r + 1 for r in t["s"].agg(F.max("k"), F.max("m")).first())
    projected = D.projections(t["orientations"], mrc.read_volume(spark, meta["volume"]), meta["pad"])
    weights = C.weights_of(t["u"].select("n", "k", "m", "re", "im"), t["s"])
    own = box_filter(meta["filter"], box)
    signal = None if own is None else rings.on_grid(np.array(meta["filter"]["average"]), *box)
    n_orientations = t["orientations"].count()
    out = None
    for rects in rectangles:
        cells = tables.cells_of(rects, k_max, eig_max)
        kern = engine.cell_kernels(engine.radial_vectors(t["vh"], grid, k_max, eig_max), grid, cells)
        rows = tables.template_rows(projected, weights, cells, n_orientations)
        one = tables.profiles(rows, kern, cells, grid, bins, n_orientations, exact_filters=None if own is None else own[None], signal_filter=signal, normalise=meta["normalize_projections"]).withColumn("tag", F.lit(tables.tag_of(rects)))
        out = one if out is None else out.unionByName(one)
    return out


def run_calibrate(spark: SparkSession, config: cfg.CalibrateConfig) -> dict[str, DataFrame]:
    """Truncation errors of the rectangles, error tables for the noise model, and suggestions for the targets."""
    t = store.load_decomposition(spark, config.decomposition)
    meta = store.read_meta(spark, config.decomposition)["config"]
    cells = E.cell_energies(t["u"].select("n", "k", "m", "re", "im"), t["s"], meta["grid"]["num_angle"])
    out: dict[str, DataFrame] = {}
    record = config.model_dump(mode="json") | {"tags": []}
    if config.rectangles:
        tables.cells_of(config.rectangles, *(r + 1 for r in t["s"].agg(F.max("k"), F.max("m")).first()))
        out["errors"] = E.truncation_error(cells, t["blocks"], config.rectangles)
        out["summary"] = E.truncation_summary(out["errors"])
    for i, target in enumerate(config.suggest):
        out[f"suggestion_{i}"] = E.suggest_rectangles(E.rho_grid(E.energy_spectrum(cells), t["blocks"]), target.max_error, target.max_components)
    if config.noise_tables:
        bins = len(meta["filter"]["average"]) if meta["filter"] else config.bins
        out["error_tables"] = noise_tables(spark, t, meta, config.noise_tables, bins)
        record |= {"tags": [tables.tag_of(r) for r in config.noise_tables], "grid": meta["grid"], "box": meta["box"], "filter": meta["filter"], "bins": bins}
    store.save(spark, config.output, "error_tables", out, record, "calibrate")
    return store.load(spark, config.output, "error_tables")


def plane_table(images: DataFrame, config: cfg.SearchConfig) -> DataFrame | None:
    """(image_id, planes): an image's own defocus plus the offsets, or the offsets alone; None where nothing is defocused."""
    if not config.micrographs and not any(config.defocus):
        return None
    plane = lambda m, o: {"defocus": o + ((m.defocus_u + m.defocus_v) / 2 if m else 0.0), "astigmatism": (m.defocus_u - m.defocus_v) / 2 if m else 0.0, "angle": m.astigmatism_angle if m else 0.0}
    kind = "array<struct<defocus:double,astigmatism:double,angle:double>>"
    common = F.lit(None).cast(kind) if config.micrographs else F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in plane(None, float(o)).items())) for o in config.defocus))
    ids = images.select("image_id")
    if not config.micrographs:
        return ids.withColumn("planes", common)
    own = images.sparkSession.createDataFrame([(k, [plane(m, float(o)) for o in config.defocus]) for k, m in config.micrographs.items()], f"image_id string, planes {kind}")
    known = F.assert_true(F.col("planes").isNotNull(), F.lit("an image has no entry in micrographs"))
    return ids.join(own, "image_id", "left").where(known.isNull())


def positions(images: DataFrame, out_h: int, out_w: int, masks: DataFrame | None, box: tuple[int, int]) -> DataFrame:
    """(image_id, pixel_id, row, col, masked) of every position."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(out_h * out_w - 1))).alias("pixel_id")
    grid = images.select("image_id", cells).select("image_id", F.col("pixel_id").cast("long").alias("pixel_id"), F.floor(F.col("pixel_id") / out_w).cast("int").alias("row"), F.pmod("pixel_id", F.lit(out_w)).cast("int").alias("col"))
    if masks is None:
        return grid.withColumn("masked", F.lit(False))
    keep = I.grid_mask(masks, box, (out_h, out_w)).withColumn("_keep", F.lit(True))
    return grid.join(keep, ["image_id", "row", "col"], "left").withColumn("masked", F.col("_keep").isNull()).drop("_keep")


def stage_of(s: cfg.StageConfig) -> S.Stage:
    d = s.decision.model_dump()
    calibration = d.pop("calibration")
    some = lambda x: None if x is None else tuple(x)
    return S.Stage(tuple(s.rectangles), s.n_psi, some(s.planes), s.level, s.rings, some(s.orientations), S.Decision(**d, calibration=T.Calibration(**calibration) if calibration else None))


def prepared_images(spark: SparkSession, config: cfg.SearchConfig, images: DataFrame, meta: dict, grid: PolarGrid, cut) -> DataFrame:
    """The images as they are searched: whitened and measured under ``whitening``, taken from ``prepared`` where that holds
    them, else only normalised."""
    if config.whitening is None:
        return cut(prepared.normalised(images), "normalised")
    recorded = whitening_filter(spark, config.whitening)
    check_template_filter(meta["filter"], recorded)
    record = config.model_dump(mode="json", include={"images", "whitening", "error_tables", "defocus", "micrographs", "pixel_size", "voltage", "spherical_aberration", "amplitude_contrast", "phase_shift", "invert"})
    if config.prepared and (found := prepared.load(spark, config.prepared, record)) is not None and images.join(found, "image_id", "left_anti").isEmpty():
        return found.join(images.select("image_id"), "image_id", "left_semi")
    planes = plane_table(images, config)
    if planes is None:
        flat = F.array(F.struct(F.lit(0.0).alias("defocus"), F.lit(0.0).alias("astigmatism"), F.lit(0.0).alias("angle")))
        planes = images.select("image_id", flat.alias("planes"))
    bins = store.read_attr(spark, config.error_tables, "bins") if config.error_tables else None
    spectra = store.load(spark, config.whitening, "whitening")["spectra"]
    out = prepared.prepare(images, spectra, planes, optics_of(config), max_freq=recorded["max_freq"], cutoff=recorded["cutoff"], falloff=recorded["falloff"], table_bins=bins, radius=tables.support_radius(tables.support(grid)))
    if config.prepared:
        prepared.save(spark, config.prepared, out, record)
        return prepared.load(spark, config.prepared)
    return cut(out, "prepared")


def optics_of(config: cfg.SearchConfig) -> prepared.Optics:
    return prepared.Optics(config.pixel_size, config.voltage, config.spherical_aberration, config.amplitude_contrast, config.phase_shift)


def run_search(spark: SparkSession, config: cfg.SearchConfig, cut=None) -> DataFrame:
    """The ledger of all images, those that the output held already among them."""
    t = store.load_decomposition(spark, config.decomposition)
    meta = store.read_meta(spark, config.decomposition)["config"]
    grid = PolarGrid.from_dict(meta["grid"])
    box = (grid.height, grid.width)
    images = mrc.read(spark, config.images)
    if config.invert:
        images = images.withColumn("data", F.transform("data", lambda x: -x))
    before = store.load_result(spark, config.output) if store.exists(spark, config.output) else {}
    done = before.get("ledger")
    images = S.unfinished(images, done)
    if done is not None and images.isEmpty():
        return done
    h, w = image_shape(images)
    (out_h, out_w), _ = I.search_grid((h, w), box)
    stages = [stage_of(s) for s in config.stages]
    execution = planning.execution_config(config.execution)
    if cut is None:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{config.output}/checkpoints")
        cut = lambda df, name: df.checkpoint()
    ready = prepared_images(spark, config, images, meta, grid, cut)
    n_orientations = t["orientations"].count()
    stored = tuple(r + 1 for r in t["s"].agg(F.max("k"), F.max("m")).first())
    n_filters = (t["u"].agg(F.max("n")).first()[0] + 1) // n_orientations
    rows = planning.plan_bands((out_h, out_w), max(s.num_features for s in stages), execution)
    bands = cut(B.plane_bands(ready, plane_table(images, config), optics_of(config), box, rows), "bands")
    B.check_complete(bands, ready, len(config.defocus), out_h, rows)
    weights = C.weights_of(t["u"].select("n", "k", "m", "re", "im"), t["s"])
    work = engine.Engine(bands, rows, (h, w), (out_h, out_w), grid, t["vh"], weights, t["orientations"], meta["nside"], len(config.defocus), n_filters, n_orientations, stored, cut, execution)
    searcher = S.Searcher(weights, stages, len(config.defocus), work.n_templates, None, cut, box=box, engine=work)
    if any(s.decision.calibration for s in stages):
        error_meta = store.read_meta(spark, config.error_tables)["config"]
        curves = cut(prepared.curve_table(ready, error_meta["bins"]), "curves")

        def scales(stage):
            table = store.error_table(spark, config.error_tables, tables.tag_of(stage.rectangles))
            tables.check_table(error_meta, meta, work.n_templates, table.select("n").distinct().count())
            return cut(T.scales(curves.drop("freq").join(table.select("f", "freq").distinct(), "f"), table.drop("freq", "tag"), config.pixel_size, stage.decision.calibration.b_factor, work.selected(stage), stage.planes), "scales")

        searcher.levels, searcher.scales = prepared.level_table(ready), scales
    masks = mrc.read_masks(spark, config.masks) if config.masks else None
    snapshots: list | None = [] if config.save_stages else None
    ledger = searcher.run(L.new_ledger(positions(images.select("image_id"), out_h, out_w, masks, box)), snapshots)
    decoded = searcher.decode(ledger, t["orientations"], config.defocus, n_filters)
    out = {"ledger": decoded if done is None else decoded.unionByName(done, allowMissingColumns=True)}
    if snapshots:
        old = before.get("stage_results")
        new = snapshots[0]
        for x in snapshots[1:]:
            new = new.unionByName(x)
        out["stage_results"] = new if old is None else new.unionByName(old, allowMissingColumns=True)
    record = config.model_dump(mode="json") | {"total_correlations": len(config.defocus) * work.n_templates * stages[-1].n_psi, "stages_json": [s.to_json() for s in stages]}
    store.save(spark, config.output, "result", out, record, "search")
    S.summary(store.table(spark, config.output, "ledger")).show(truncate=False)
    return store.table(spark, config.output, "ledger")


def run_export(spark: SparkSession, config: cfg.ExportConfig) -> DataFrame:
    ledger = store.load_result(spark, config.result)["ledger"]
    searched = store.read_meta(spark, config.result)["config"]
    decomposition = store.read_meta(spark, searched["decomposition"])["config"]
    box = (decomposition["box"], decomposition["box"])
    maps = L.exchange_maps(ledger)
    store.append_maps(config.result, maps)
    picked = L.pick_particles(ledger, config.radius)
    optics = {"voltage": searched["voltage"], "spherical_aberration": searched["spherical_aberration"], "amplitude_contrast_ratio": searched["amplitude_contrast"], "phase_shift": searched["phase_shift"]} | config.optics
    table = L.particle_table(maps, picked, box, config.pixel_size, searched["total_correlations"], optics, searched["micrographs"])
    if picked.isEmpty():
        raise ValueError("the result holds no particles")
    store.save(spark, config.output, "particles", {"particles": table}, config.model_dump(mode="json"), "export")
    return store.table(spark, config.output, "particles")


RUN = {"whitening": run_whitening, "decompose": run_decompose, "calibrate": run_calibrate, "search": run_search, "export": run_export}


def main(args: Sequence[str] | None = None) -> None:
    """``python -m tessella.plans.programs PROGRAM config.yaml`` or ``PROGRAM --example``."""
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("program", choices=sorted(RUN))
    p.add_argument("config", nargs="?")
    p.add_argument("--example", action="store_true")
    a = p.parse_args(args)
    if a.example or not a.config:
        print(cfg.example(a.program), end="")
        return
    spark = SparkSession.builder.appName(f"tessella {a.program}").getOrCreate()
    RUN[a.program](spark, cfg.PROGRAMS[a.program].from_yaml(a.config))


if __name__ == "__main__":
    main()
