"""The ledger of searched pixels: upserts, decisions, absorption and reports.

A ledger is (image_id, pixel_id, row, col, label, mip, mean, variance, zscore, best_index, best_psi, last_stage, score).
What was never searched is NULL; comparisons guard against NaN, which Spark orders above all numbers.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values
LABELS = {"PENDING": 0, "AMBIGUOUS": 1, "REJECTED": 2, "ACCEPTED": 3, "ABSORBED": 4, "MASKED": 5}
#: What a never-searched position shows as its deviation in the exchange maps: larger than any correlation.
PADDING = 1e10

MAP_COLUMNS = ("mip", "mean", "variance", "zscore", "best_index", "best_psi")


def known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def zscore_threshold(n_pixels: int, n_hypotheses: int) -> float:
    """The z that noise alone is expected to pass once in all tests."""
    if n_pixels * n_hypotheses < 1:
        raise ValueError("a threshold needs at least one test")
    return NormalDist().inv_cdf(1 - 1 / (n_pixels * n_hypotheses)) if n_pixels * n_hypotheses > 1 else -math.inf


# The rational approximations of the normal quantile by Wichura (Algorithm AS 241, 1988), lowest power first. Fixed values.
QUANTILE = {
    "center": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "middle": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "tail": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def _rational(part: str, x: Column) -> Column:
    top, below = (sum((F.lit(v) * F.pow(x, F.lit(float(i))) for i, v in enumerate(p[1:], 1)), start=F.lit(p[0])) for p in QUANTILE[part])
    return top / below


def threshold_column(tests: Column) -> Column:
    """``zscore_threshold`` of a column of tests, each at least 1: the normal quantile that is passed once in so many."""
    n = tests.cast("double")
    q = 0.5 - 1.0 / n
    r = F.sqrt(F.log(n))  # of the upper tail
    upper = F.when(r <= 5, _rational("middle", r - 1.6)).otherwise(_rational("tail", r - 5.0))
    lower = -_rational("middle", F.sqrt(-F.log1p(-1.0 / n)) - 1.6)
    return F.when(n <= 1, F.lit(-math.inf)).when(F.abs(q) <= 0.425, q * _rational("center", 0.180625 - q * q)).when(q > 0, upper).otherwise(lower)


def new_ledger(pixels: DataFrame) -> DataFrame:
    """A pending row for each (image_id, pixel_id, row, col); ``masked`` positions, where given, are marked."""
    label = F.when(F.col("masked"), LABELS["MASKED"]).otherwise(LABELS["PENDING"]) if "masked" in pixels.columns else F.lit(LABELS["PENDING"])
    null = lambda kind: F.lit(None).cast(kind)
    return pixels.select(
        "image_id", "pixel_id", "row", "col", label.cast("tinyint").alias("label"), *(null("double").alias(c) for c in ("mip", "mean", "variance", "zscore")), null("long").alias("best_index"), null("int").alias("best_psi"), null("smallint").alias("last_stage"), null("double").alias("score")
    )


def write_maps(ledger: DataFrame, maps: DataFrame, stage: int) -> DataFrame:
    """Upsert of a stage's maps: its pixels become AMBIGUOUS, lose their score and carry the stage's number."""
    new = maps.select("image_id", "pixel_id", *(F.col(c).alias(f"new_{c}") for c in MAP_COLUMNS), F.lit(True).alias("hit"))
    j = ledger.join(new, ["image_id", "pixel_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    pick = {c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in MAP_COLUMNS}
    pick |= {"label": F.when(hit, F.lit(LABELS["AMBIGUOUS"])).otherwise(F.col("label")).cast("tinyint"), "last_stage": F.when(hit, F.lit(stage)).otherwise(F.col("last_stage")).cast("smallint"), "score": F.when(~hit, F.col("score"))}
    return j.select(*(pick.get(c, F.col(c)).alias(c) for c in ledger.columns))


def set_values(ledger: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """The ledger with ``column`` taken from (image_id, pixel_id, value) where given."""
    j = ledger.join(updates.select("image_id", "pixel_id", F.col("value").alias("_v"), F.lit(True).alias("_hit")), ["image_id", "pixel_id"], "left")
    return j.select(*(F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(c)).cast(ledger.schema[c].dataType).alias(c) if c == column else F.col(c) for c in ledger.columns))


def pixels_with(ledger: DataFrame, *labels: str) -> DataFrame:
    return ledger.where(F.col("label").isin([LABELS[x] for x in labels]))


def next_stage_pixels(ledger: DataFrame) -> DataFrame:
    """What the next stage searches: ambiguous and accepted pixels, not absorbed ones."""
    return pixels_with(ledger, "AMBIGUOUS", "ACCEPTED")


def std(variance: Column) -> Column:
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def plain_label(z: Column, threshold: Column | float, accept: bool, reject: bool = True) -> Column:
    """Strict on both sides: at the threshold a pixel stays ambiguous, as does one whose z is not known."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    out = F.when(~known(z), F.lit(LABELS["AMBIGUOUS"]))
    if reject:
        out = out.when(z < t, F.lit(LABELS["REJECTED"]))
    if accept:
        out = out.when(z > t, F.lit(LABELS["ACCEPTED"]))
    return out.otherwise(F.lit(LABELS["AMBIGUOUS"])).cast("tinyint")


def tested_label(z: Column, threshold: Column | float, score: Column, z_alpha: float, accept: bool) -> Column:
    """As ``plain_label``, but a pixel is rejected only when its noise-model distance reaches z_alpha."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    out = F.when(known(score) & (score >= z_alpha), F.lit(LABELS["REJECTED"]))
    if accept:
        out = out.when(known(z) & (z > t), F.lit(LABELS["ACCEPTED"]))
    return out.otherwise(F.lit(LABELS["AMBIGUOUS"])).cast("tinyint")


def near(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of one image within ``radius``: tiles of that size, each probing its nine, then the exact distance.

    ``right`` columns carry the prefix r_.
    """
    tile = max(1, math.ceil(radius))
    a = left.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("_s", F.explode(shifts))
    b = b.withColumn("_tr", F.floor(F.col("r_row") / tile) + F.col("_s.i")).withColumn("_tc", F.floor(F.col("r_col") / tile) + F.col("_s.j")).withColumn("image_id", F.col("r_image_id")).drop("_s", "r_image_id")
    dr, dc = F.col("row") - F.col("r_row"), F.col("col") - F.col("r_col")
    return a.join(b, ["image_id", "_tr", "_tc"]).where(dr * dr + dc * dc <= radius * radius).withColumn("dist2", dr * dr + dc * dc).drop("_tr", "_tc")


def absorb_near_accepted(ledger: DataFrame, radius: float) -> DataFrame:
    """Ambiguous pixels within ``radius`` of an accepted one, in the whole ledger, become ABSORBED."""
    hit = near(pixels_with(ledger, "AMBIGUOUS").select("image_id", "pixel_id", "row", "col"), pixels_with(ledger, "ACCEPTED").select("image_id", "row", "col"), radius)
    hit = hit.select("image_id", "pixel_id").distinct().withColumn("_hit", F.lit(True))
    return ledger.join(hit, ["image_id", "pixel_id"], "left").withColumn("label", F.when(F.col("_hit"), F.lit(LABELS["ABSORBED"])).otherwise(F.col("label")).cast("tinyint")).select(*ledger.columns)


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, v in LABELS.items()], "label tinyint, name string")


def label_counts(ledger: DataFrame) -> DataFrame:
    """(image_id, label, name, pixels) with zeros for labels that an image lacks."""
    grid = ledger.select("image_id").distinct().select("image_id", F.explode(F.array(*[F.struct(F.lit(v).cast("tinyint").alias("label"), F.lit(k).alias("name")) for k, v in LABELS.items()])).alias("x")).select("image_id", "x.*")
    return grid.join(ledger.groupBy("image_id", "label").count(), ["image_id", "label"], "left").select("image_id", "label", "name", F.coalesce("count", F.lit(0)).alias("pixels"))


def correlation_scale(ledger: DataFrame) -> DataFrame:
    """(image_id, scale): the lower median of the deviations of searched pixels."""
    sd = ledger.where(F.col("last_stage").isNotNull() & known(F.col("variance"))).select("image_id", std(F.col("variance")).alias("sd"))
    return sd.groupBy("image_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sd)").alias("scale"))


def exchange_maps(decoded: DataFrame) -> DataFrame:
    """The eight exchange maps of a decoded ledger, correlations in units of the image's scale; 0, and PADDING for the
    deviation, where a position was not searched or a value is not finite."""
    j = decoded.join(correlation_scale(decoded), "image_id", "left")
    raw = {
        "mip": F.col("mip") / F.col("scale"), "scaled_mip": F.col("zscore"), "correlation_average": F.col("mean") / F.col("scale"), "correlation_variance": std(F.col("variance")) / F.col("scale"),
        "orientation_psi": F.col("psi"), "orientation_theta": F.col("theta"), "orientation_phi": F.col("phi"), "relative_defocus": F.col("defocus"),
    }
    ok = lambda v: F.col("last_stage").isNotNull() & known(v) & (F.abs(v) != float("inf"))
    return j.select("image_id", "pixel_id", "row", "col", *(F.when(ok(v.cast("double")), v.cast("double")).otherwise(F.lit(PADDING if k == "correlation_variance" else 0.0)).alias(k) for k, v in raw.items()))


def pick_particles(ledger: DataFrame, radius: float) -> DataFrame:
    """One pixel per particle: of accepted and ambiguous pixels those that no stronger one within ``radius`` covers, and
    of these the nearest to some accepted pixel. Of equal z the smaller pixel id is the stronger."""
    cand = next_stage_pixels(ledger).where(known(F.col("zscore")))
    pts = cand.select("image_id", "pixel_id", "row", "col", "zscore")
    stronger = (F.col("r_zscore") > F.col("zscore")) | ((F.col("r_zscore") == F.col("zscore")) & (F.col("r_pixel_id") < F.col("pixel_id")))
    covered = near(pts, pts, radius).where(stronger).select("image_id", "pixel_id").distinct()
    peaks = cand.join(covered, ["image_id", "pixel_id"], "left_anti").persist()  # few, and read by each step that follows
    accepted = pixels_with(ledger, "ACCEPTED").select("image_id", "pixel_id", "row", "col")
    owners = nearest(accepted, peaks.select("image_id", "pixel_id", "row", "col"), radius)
    return peaks.join(owners.select("image_id", F.col("r_pixel_id").alias("pixel_id")).distinct(), ["image_id", "pixel_id"], "left_semi")


def nearest(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(image_id, pixel_id, r_pixel_id): the nearest target of the image, of equal ones that with the smallest id.

    Most points have one near by. Tiles widen fourfold for those that have found none within them, until none is left
    whose image has targets, so any distance is covered.
    """
    left = points.join(targets.select("image_id").distinct(), "image_id", "left_semi")
    found, reach = None, max(1.0, 4.0 * radius)
    while True:
        one = near(left, targets, reach).groupBy("image_id", "pixel_id").agg(F.min(F.struct("dist2", "r_pixel_id")).alias("x")).select("image_id", "pixel_id", "x.r_pixel_id").persist()
        found = one if found is None else found.unionByName(one)
        left = left.join(one, ["image_id", "pixel_id"], "left_anti")
        if left.isEmpty():
            return found
        reach *= 4


def particle_table(maps: DataFrame, picked: DataFrame, box: tuple[int, int], pixel_size: float, n_hypotheses: int, optics: dict | None = None, micrographs: dict | None = None) -> DataFrame:
    """Particle rows: values at the peaks, positions of the box corner and center in pixels and Angstrom, a running index,
    and the columns of ``optics``; ``micrographs`` has the defocus of images by id."""
    rows = picked.select("image_id", "pixel_id", "label", "score", F.col("last_stage").alias("stage")).join(maps, ["image_id", "pixel_id"])
    y, x = F.col("row") + box[0] // 2, F.col("col") + box[1] // 2
    # a running index without a single task: particles are numbered in their image, after those of the images before
    sizes = picked.groupBy("image_id").count()
    before = sizes.select("image_id", (F.sum("count").over(Window.orderBy("image_id")) - F.col("count")).alias("before"))  # a row an image
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("pixel_id")) - 1).join(before, "image_id")
    index = F.col("before") + F.col("i")
    taken = {"label", "score", "stage", "mip", "psi", "theta", "phi", "image_id"}
    more = [F.lit(v).alias(f"optics_{k}" if k in taken else k) for k, v in (optics or {}).items()]
    if micrographs:
        per_image = F.create_map(*(F.lit(v) for k, m in micrographs.items() for v in (k, float(m["defocus_u"])))), F.create_map(*(F.lit(v) for k, m in micrographs.items() for v in (k, float(m["defocus_v"])))), F.create_map(*(F.lit(v) for k, m in micrographs.items() for v in (k, float(m["astigmatism_angle"]))))
        more += [F.try_element_at(m, F.col("image_id").cast("string")).alias(c) for m, c in zip(per_image, ("defocus_u", "defocus_v", "astigmatism_angle"), strict=True)]
    return rows.select(
        index.cast("long").alias("particle_index"), "image_id", F.col("row").alias("pos_y"), F.col("col").alias("pos_x"), y.alias("pos_y_img"), x.alias("pos_x_img"), (y * pixel_size).alias("pos_y_img_angstrom"), (x * pixel_size).alias("pos_x_img_angstrom"),
        "mip", "scaled_mip", F.col("orientation_psi").alias("psi"), F.col("orientation_theta").alias("theta"), F.col("orientation_phi").alias("phi"), "relative_defocus", F.col("correlation_average").alias("correlation_mean"), "correlation_variance",
        F.lit(n_hypotheses).cast("long").alias("total_correlations"), "label", "score", "stage", *more,
    )
