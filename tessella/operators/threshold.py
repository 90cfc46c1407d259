"""The noise-model threshold test: how far a pixel's predicted exact correlation lies below a lowered threshold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calibration:
    alpha: float = 0.01
    zeta: float = 1.0
    eps_rho: float = 0.0
    b_factor: float = 0.0

    def __post_init__(self):
        if not 0 < self.alpha < 1:
            raise ValueError(f"alpha lies between 0 and 1, got {self.alpha}")
        if self.zeta <= 0 or self.eps_rho < 0 or self.b_factor < 0:
            raise ValueError("zeta is positive, eps_rho and b_factor are not negative")

    @property
    def z_alpha(self) -> float:
        return NormalDist().inv_cdf(1 - self.alpha)


def scales(curves: DataFrame, table: DataFrame, pixel_size: float, b_factor: float = 0.0, rows: DataFrame | None = None, planes: Sequence[int] | None = None) -> DataFrame:
    """(image_id, plane, n, q_kept, q_perp, lam, rho, qbar_perp).

    ``curves`` is (image_id, plane, f, freq, noise, signal), ``table`` (n, f, rec_auto, res_auto, rec_res, sig_rec,
    sig_res). qbar_perp averages q_perp over the stage's ``rows`` (n) and ``planes`` (all, if none are given).
    """
    c = F.col
    j = curves.join(table, "f")
    weight = c("signal") * F.exp(-b_factor * F.pow(c("freq") / pixel_size, 2) / 4.0)
    sums = j.groupBy("image_id", "plane", "n").agg(
        F.sum(c("noise") * c("rec_auto")).alias("q_kept"), F.sum(c("noise") * c("res_auto")).alias("q_res"), F.sum(c("noise") * c("rec_res")).alias("q_cross"),
        F.sum(weight * c("sig_rec")).alias("g_kept"), F.sum(weight * c("sig_res")).alias("g_res"),
    )
    lam = F.when(c("q_kept") > 0, F.try_divide("q_cross", "q_kept")).otherwise(0.0)
    total = c("g_kept") + c("g_res")
    rho = F.least(F.greatest(F.when(total > 0, F.try_divide(c("g_res"), total)).otherwise(0.0), F.lit(0.0)), F.lit(1 - 1e-6))
    out = sums.withColumn("lam", lam).withColumn("rho", rho).withColumn("q_perp", F.greatest(c("q_res") - c("lam") * c("lam") * c("q_kept"), F.lit(0.0)))
    stage = out if rows is None else out.join(rows.select("n").distinct(), "n", "left_semi")
    stage = stage if planes is None else stage.where(c("plane").isin([int(p) for p in planes]))
    mean = stage.groupBy("image_id").agg(F.avg("q_perp").alias("qbar_perp"))
    return out.join(mean, "image_id").select("image_id", "plane", "n", "q_kept", "q_perp", "lam", "rho", "qbar_perp")


def distance(cal: Calibration, threshold: Column | float) -> Column:
    """D over the columns mip, mean, variance, level, q_kept, q_perp, lam, rho, qbar_perp. Double in, float out."""
    c = F.col
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    x = c("mip") - c("mean")
    a = c("rho") / (1.0 - c("rho"))
    sigma = F.sqrt(F.greatest(c("variance") + c("level") * c("qbar_perp"), F.lit(0.0)))
    low = c("mean") + t * cal.zeta * sigma
    predicted = c("mean") + x / (1.0 - c("rho"))
    sd2 = F.pow(a - c("lam"), 2) * c("level") * c("q_kept") + c("level") * c("q_perp") + F.pow(cal.eps_rho * a * x, 2)
    return ((low - predicted) / F.sqrt(F.greatest(sd2, F.lit(1e-30)))).cast("float")


def score(pixels: DataFrame, levels: DataFrame, scale_table: DataFrame, cal: Calibration, threshold: Column | float, box: tuple[int, int]) -> DataFrame:
    """``pixels`` (image_id, row, col, plane, n, mip, mean, variance, ..) with their score.

    The level is that of the box's center, (h - 1) // 2 from its corner; both lookups are equi-joins.
    """
    at = levels.select("image_id", (F.col("row") - (box[0] - 1) // 2).alias("row"), (F.col("col") - (box[1] - 1) // 2).alias("col"), "level")
    j = pixels.join(at, ["image_id", "row", "col"]).join(scale_table, ["image_id", "plane", "n"])
    return j.withColumn("score", distance(cal, threshold)).drop("level", "q_kept", "q_perp", "lam", "rho", "qbar_perp")
