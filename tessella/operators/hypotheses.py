"""Hypothesis ids: mixed radix of (defocus plane, filter, orientation), subsets, neighborhoods and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decode(global_id: Column, n_filters: int, n_orientations: int) -> dict[str, Column]:
    """plane, filter and orientation of a global id; a negative or null id gives -1 for each."""
    ok = global_id >= 0
    orient = F.pmod(global_id, F.lit(n_orientations))
    rest = F.floor(global_id / n_orientations)
    return {k: F.when(ok, v.cast("long")).otherwise(F.lit(-1).cast("long")) for k, v in {"plane": F.floor(rest / n_filters), "filter": F.pmod(rest, F.lit(n_filters)), "orientation": orient}.items()}


def space(spark: SparkSession, n_planes: int, n_filters: int, n_orientations: int) -> DataFrame:
    """(global_id, plane, filter, orientation, n): all hypotheses; n is the template row, filter * orientations + orientation."""
    ids = spark.range(n_planes * n_filters * n_orientations).withColumnRenamed("id", "global_id")
    got = decode(F.col("global_id"), n_filters, n_orientations)
    return ids.select("global_id", *(v.alias(k) for k, v in got.items())).withColumn("n", F.col("filter") * n_orientations + F.col("orientation"))


def sorted_unique_ids(ids: DataFrame, upper: int, column: str = "id") -> DataFrame:
    """Distinct ids in order; an id outside 0 .. upper - 1 fails the query."""
    inside = F.assert_true((F.col(column) >= 0) & (F.col(column) < upper), F.lit(f"{column} outside 0..{upper - 1}"))
    return ids.select(column).where(inside.isNull()).distinct().orderBy(column)


def template_rows(orientations: DataFrame, filters: Sequence[int], n_orientations: int) -> DataFrame:
    """(n, filter, orientation) of every orientation with every filter."""
    return orientations.select(F.explode(F.array(*map(F.lit, filters))).alias("filter"), "orientation").select((F.col("filter") * n_orientations + F.col("orientation")).cast("long").alias("n"), "filter", "orientation")


def virtual_to_global(best: DataFrame, selected: DataFrame) -> DataFrame:
    """``best`` with global_id for its best_virtual: ``selected`` holds (virtual_id, global_id). -1 where none is found."""
    return best.join(selected.select(F.col("virtual_id").alias("best_virtual"), "global_id"), "best_virtual", "left").withColumn("global_id", F.coalesce("global_id", F.lit(-1).cast("long")))


def select_hypotheses(hypotheses: DataFrame, planes: Sequence[int] | None = None, templates: DataFrame | None = None) -> DataFrame:
    """(virtual_id, global_id, plane, n): the chosen planes and template rows, planes outer, as virtual ids from 0."""
    out = hypotheses
    if planes is not None:
        out = out.where(F.col("plane").isin([int(p) for p in planes]))
    if templates is not None:
        out = out.join(templates.select("n").distinct(), "n", "left_semi")
    per = Window.partitionBy("plane").orderBy("n")
    rank = out.withColumn("j", F.row_number().over(per) - 1).withColumn("size", F.count("*").over(Window.partitionBy("plane")))
    place = rank.select("plane").distinct().withColumn("d", F.row_number().over(Window.orderBy("plane")) - 1)  # a row a plane
    return rank.join(place, "plane").select((F.col("d") * F.col("size") + F.col("j")).cast("long").alias("virtual_id"), "global_id", "plane", "n")


def batches(hypotheses: DataFrame, size: int) -> DataFrame:
    """The contiguous batch of each virtual id."""
    return hypotheses.withColumn("batch", F.floor(F.col("virtual_id") / size).cast("long"))


def at_level(ipix: Column, level: int) -> Column:
    """Whether a nested pixel stands for its ancestor ``level`` levels up."""
    return F.pmod(ipix, F.lit(4**level)) == 0


def neighborhoods(neighbors: DataFrame, orientations: DataFrame, level: int, base: int, rings: int, filters: Sequence[int], n_orientations: int) -> DataFrame:
    """(cell, n): for every base cell the template rows within ``rings`` rings of its pixels on the stage's grid.

    ``neighbors`` is (pixel, neighbor) of the stage's grid; ``orientations`` is (orientation, ipix) of the finest.
    ``rings`` is small and fixed, so that the repeated join has a fixed depth.
    """
    stage = neighbors.select("pixel").distinct()
    reach = stage.select("pixel", F.col("pixel").alias("near"))
    for _ in range(rings):
        step = reach.join(neighbors.select(F.col("pixel").alias("near"), "neighbor"), "near").select("pixel", F.col("neighbor").alias("near"))
        reach = reach.union(step).distinct()
    cells = reach.select(F.floor(F.col("pixel") / 4 ** (base - level)).cast("long").alias("cell"), F.col("near").alias("stage_pixel")).distinct()
    own = orientations.where(at_level(F.col("ipix"), level)).select("orientation", F.floor(F.col("ipix") / 4**level).cast("long").alias("stage_pixel"))
    return template_rows(cells.join(own, "stage_pixel").select("cell", "orientation").distinct(), filters, n_orientations).join(
        cells.join(own, "stage_pixel").select("cell", "orientation").distinct(), "orientation"
    ).select("cell", "n").distinct()


def unique_rows(values: Column) -> Column:
    """The distinct non-negative values of an array, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x >= 0)))


def tiles(pixels: DataFrame, size: int, group: str = "cell", order: str = "p") -> DataFrame:
    """``pixels`` with the tile of each row: its rank within the group, cut every ``size`` rows."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return pixels.withColumn("slot", F.pmod(rank, F.lit(size)).cast("int")).withColumn("tile", F.floor(rank / size).cast("long"))


def psi_degrees(index: Column, n_psi: Column | int) -> Column:
    return F.lit(360.0) * index / n_psi
