"""Registered queries of the engine's operators over the driver tables, and their SQL.

Floating results are rounded, and zeros are unsigned, on both sides. Whole tables are read everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import healpix
from tessella.functions.healpix import unit_vectors
from tessella.functions.polar import PolarGrid
from tessella.operators import correlate as C
from tessella.operators import decompose as D
from tessella.operators import energies as E
from tessella.operators import hypotheses as H
from tessella.operators import imaging as I
from tessella.operators import ledger as L
from tessella.operators import threshold as T
from tessella.plans import search as S
from tessella.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long."""
    kinds = {"double", "float"}
    ints = {"int", "bigint", "tinyint", "smallint"}
    return df.select(*((F.round(c(n).cast("double"), digits) + 0.0).alias(n) if k in kinds else c(n).cast("long").alias(n) if k in ints else c(n) for n, k in df.dtypes))


def sql(ctes: str, body: str, columns: str, digits: int = 6) -> str:
    """SELECT of ``columns`` (name:kind, kind d double, l long, s as it is) from ``body`` after the CTEs."""
    picks = []
    for item in columns.split():
        n, k = item.split(":")
        picks.append({"d": f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}", "l": f"CAST({n} AS BIGINT) AS {n}", "s": n}[k])
    return f"WITH {ctes}{', ' if ctes else ''}final_rows AS ({body}) SELECT {', '.join(picks)} FROM final_rows"


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


FEATURES = """features AS (SELECT vec_id AS p, label, CAST(i // 8 AS INT) AS k, CAST(i % 8 AS INT) AS m, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im
  FROM embeddings, (SELECT unnest(range(0, 32)) AS i))"""
WEIGHTS = f"""{FEATURES}, weights AS (SELECT CAST(label AS BIGINT) AS n, k, m, avg(re) AS re, avg(im) AS im FROM features GROUP BY label, k, m)"""


def spectrum_sql(n_psi: int, feats: str = "features", pairs: str = "") -> str:
    nyq = n_psi // 2
    return f"""spec0 AS (SELECT y.p, w.n, y.k, sum(y.re * w.re + y.im * w.im) AS cr, sum(y.im * w.re - y.re * w.im) AS ci FROM {feats} y JOIN weights w ON y.k = w.k AND y.m = w.m {pairs} GROUP BY y.p, w.n, y.k),
spec AS (SELECT p, n, k, cr, CASE WHEN k IN (0, {nyq}) THEN 0 ELSE ci END AS ci FROM spec0)"""


def search_sql(n_psi: int, feats: str = "features", pairs: str = "", n_templates: int = 10) -> str:
    nyq, tau = n_psi // 2, f"2 * pi() * k * psi / {n_psi}"
    return f"""{spectrum_sql(n_psi, feats, pairs)},
corr AS (SELECT p, n, psi, sum(CASE WHEN k = 0 THEN cr WHEN k = {nyq} THEN cr * cos({tau}) ELSE 2 * (cr * cos({tau}) - ci * sin({tau})) END) AS c FROM spec, (SELECT unnest(range(0, {n_psi})) AS psi) GROUP BY p, n, psi),
ranked AS (SELECT p, round(c, 6) AS c, n, psi, row_number() OVER (PARTITION BY p ORDER BY round(c, 6) DESC, n, psi) AS i FROM corr),
mom AS (SELECT p, {n_psi} * sum(CASE WHEN k = 0 THEN cr ELSE 0 END) AS s1, {n_psi} * sum(CASE WHEN k IN (0, {nyq}) THEN cr * cr ELSE 2 * (cr * cr + ci * ci) END) AS s2 FROM spec GROUP BY p),
maps AS (SELECT r.p, r.c AS mip, r.n AS best_virtual, ({n_psi} - r.psi) % {n_psi} AS best_psi, s1 / {n_templates * n_psi} AS mean, greatest(s2 / {n_templates * n_psi} - (s1 / {n_templates * n_psi}) * (s1 / {n_templates * n_psi}), 0) AS variance FROM ranked r JOIN mom ON r.p = mom.p WHERE i = 1)"""


SEARCHED = "SELECT *, (mip - mean) / greatest(sqrt(variance), 1e-12) AS zscore FROM maps"
MAP_COLUMNS = "p:l mip:d best_virtual:l best_psi:l mean:d variance:d zscore:d"


@register("correlate_search", sql(WEIGHTS + ", " + search_sql(16), SEARCHED, MAP_COLUMNS))
def correlate_search(spark, sf):
    return tidy(C.search(A.features(spark, sf).drop("label"), A.weights(spark, sf), 16, 10, digits=6))


@register("correlate_search_nyquist", sql(WEIGHTS + ", " + search_sql(6), SEARCHED, MAP_COLUMNS))
def correlate_search_nyquist(spark, sf):
    return tidy(C.search(A.features(spark, sf).drop("label"), A.weights(spark, sf), 6, 10, digits=6))


def _packed_search(spark, sf, n_psi):
    feats, w = A.features(spark, sf), A.weights(spark, sf)
    block = C.weight_block(w, A.K, A.M)
    if block is None:  # too large for every task: the relational form
        return C.search(feats.drop("label"), w, n_psi, 10, digits=6)
    return C.search_packed(C.pack(feats, A.K, A.M), block, n_psi, digits=6)


@register("correlate_arrow", sql(WEIGHTS + ", " + search_sql(16), SEARCHED, MAP_COLUMNS))
def correlate_arrow(spark, sf):
    return tidy(_packed_search(spark, sf, 16))


@register("contract", sql(WEIGHTS + ", " + spectrum_sql(16), "SELECT p, n, k, cr, ci FROM spec0", "p:l n:l k:l cr:d ci:d"))
def contract(spark, sf):
    return tidy(C.contract(A.features(spark, sf), A.weights(spark, sf)))


@register("hermitian_spectrum", sql(WEIGHTS + ", " + spectrum_sql(6), "SELECT p, n, k, cr, ci FROM spec", "p:l n:l k:l cr:d ci:d"))
def hermitian_spectrum(spark, sf):
    return tidy(C.hermitian(C.contract(A.features(spark, sf), A.weights(spark, sf)), 6))


MOMENTS_BODY = "SELECT p, s1, s2 FROM mom"


@register("parseval_moments", sql(WEIGHTS + ", " + search_sql(6), MOMENTS_BODY, "p:l s1:d s2:d", 5))
def parseval_moments(spark, sf):
    return tidy(C.moments(C.hermitian(C.contract(A.features(spark, sf), A.weights(spark, sf)), 6), 6), 5)


@register("moment_forms", sql(WEIGHTS + ", " + search_sql(6), MOMENTS_BODY, "p:l s1:d s2:d", 5))
def moment_forms(spark, sf):
    return tidy(C.form_moments(A.features(spark, sf), A.weights(spark, sf), 6), 5)


PLANES = f"""{WEIGHTS}, planes AS (SELECT p, 0 AS plane, k, m, re, im FROM features UNION ALL SELECT p, 1, k, m, im, re FROM features),
spec AS (SELECT y.p, y.plane, w.n, y.k, sum(y.re * w.re + y.im * w.im) AS cr, CASE WHEN y.k = 0 THEN 0 ELSE sum(y.im * w.re - y.re * w.im) END AS ci FROM planes y JOIN weights w ON y.k = w.k AND y.m = w.m GROUP BY y.p, y.plane, w.n, y.k),
corr AS (SELECT p, plane, n, psi, sum(CASE WHEN k = 0 THEN cr ELSE 2 * (cr * cos(2 * pi() * k * psi / 8) - ci * sin(2 * pi() * k * psi / 8)) END) AS c FROM (SELECT * FROM spec WHERE k < 4), (SELECT unnest(range(0, 8)) AS psi) GROUP BY p, plane, n, psi),
best AS (SELECT p, plane, round(c, 6) AS c, n, psi, row_number() OVER (PARTITION BY p ORDER BY round(c, 6) DESC, plane, n, psi) AS i FROM corr),
per AS (SELECT p, plane, avg(c) AS mean, greatest(avg(c * c) - avg(c) * avg(c), 0) AS variance FROM corr GROUP BY p, plane),
pooled AS (SELECT p, avg(mean) AS mean, avg(variance + mean * mean) AS m2 FROM per GROUP BY p),
maps AS (SELECT b.p, b.c AS mip, b.plane, b.n AS best_virtual, (8 - psi) % 8 AS best_psi, mean, greatest(m2 - mean * mean, 0) AS variance FROM best b JOIN pooled q ON b.p = q.p WHERE i = 1)"""


@register("merge_stage_maps", sql(PLANES, SEARCHED, "p:l mip:d plane:l best_virtual:l best_psi:l mean:d variance:d zscore:d"))
def merge_stage_maps(spark, sf):
    feats, w = A.features(spark, sf).drop("label"), A.weights(spark, sf)
    swapped = feats.select("p", "k", "m", c("im").alias("re"), c("re").alias("im"))
    parts = C.concat_stage_maps([C.search(f, w, 8, 10, digits=6).withColumn("plane", F.lit(i)) for i, f in enumerate((feats, swapped))])
    return tidy(C.merge_stage_maps(parts))


@register("local_search", sql(WEIGHTS + ", " + search_sql(16, pairs="AND (w.n % 5 = y.p % 5 OR w.n % 5 = (y.p + 1) % 5)"), "SELECT p, mip, best_virtual, best_psi FROM maps", "p:l mip:d best_virtual:l best_psi:l"))
def local_search(spark, sf):
    feats, w = A.features(spark, sf).drop("label"), A.weights(spark, sf)
    seeds = feats.select("p").distinct().select("p", F.pmod("p", F.lit(5)).alias("cell"))
    n = w.select("n").distinct()
    hood = n.select(F.pmod("n", F.lit(5)).alias("cell"), "n").union(n.select(F.pmod(c("n") - 1, F.lit(5)), "n"))
    return tidy(C.search_local(feats, w, seeds, hood, 16, digits=6))


@register("rectangle_weights", sql(WEIGHTS, "SELECT n, k, m, re, im FROM weights WHERE (k < 2 AND m < 3) OR (k BETWEEN 1 AND 3 AND m BETWEEN 4 AND 5)", "n:l k:l m:l re:d im:d"))
def rectangle_weights(spark, sf):
    return tidy(A.weights(spark, sf).where(C.in_rectangles([(0, 0, 2, 3), (1, 4, 3, 2)])))


SV = f"""{FEATURES}, s AS (SELECT k, m, avg(abs(re)) + 1.0 / (1 + k + m) AS s FROM features GROUP BY k, m),
cells AS (SELECT p AS n, f.k, f.m, CASE WHEN f.k IN (0, 8) THEN 1.0 ELSE 2.0 END * (re * re + im * im) * s * s AS energy FROM features f JOIN s ON f.k = s.k AND f.m = s.m),
blocks AS (SELECT n, k, sum(energy) * 1.25 AS energy FROM cells GROUP BY n, k)"""


def _decomposition(spark, sf):
    u = A.features(spark, sf).select(c("p").alias("n"), "k", "m", "re", "im")
    s = A.singular_values(spark, sf)
    cells = E.cell_energies(u, s, 16)
    return u, s, cells, cells.groupBy("n", "k").agg((F.sum("energy") * 1.25).alias("energy"))


@register("weights_of", sql(SV, "SELECT n, sum(re * s) AS re, sum(im * s) AS im FROM (SELECT p AS n, re, im, s FROM features f JOIN s ON f.k = s.k AND f.m = s.m) GROUP BY n", "n:l re:d im:d"))
def weights_of(spark, sf):
    u, s, _, _ = _decomposition(spark, sf)
    return tidy(C.weights_of(u, s).groupBy("n").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))


ERRORS = f"""{SV}, total AS (SELECT n, sum(energy) AS energy, sum(CASE WHEN k < 3 THEN energy ELSE 0 END) AS reached FROM blocks GROUP BY n),
kept AS (SELECT n, sum(energy) AS kept FROM cells WHERE (k < 2 AND m < 5) OR (k BETWEEN 1 AND 2 AND m < 3) GROUP BY n),
errors AS (SELECT t.n, energy, energy - reached AS angular_loss, greatest(reached - kept, 0) AS eigen_loss FROM total t JOIN kept USING (n))"""
RECTS = [(0, 0, 2, 5), (1, 0, 2, 3)]


@register("truncation_error", sql(ERRORS, "SELECT * FROM errors", "n:l energy:d angular_loss:d eigen_loss:d"))
def truncation_error(spark, sf):
    _, _, cells, blocks = _decomposition(spark, sf)
    return tidy(E.truncation_error(cells, blocks, RECTS))


@register("truncation_summary", sql(ERRORS, "SELECT sqrt(sum(angular_loss + eigen_loss) / sum(energy)) AS rho, sqrt(sum(angular_loss) / sum(energy)) AS rho_k, sqrt(sum(eigen_loss) / sum(energy)) AS rho_m, max(sqrt((angular_loss + eigen_loss) / energy)) AS rho_max FROM errors", "rho:d rho_k:d rho_m:d rho_max:d"))
def truncation_summary(spark, sf):
    _, _, cells, blocks = _decomposition(spark, sf)
    return tidy(E.truncation_summary(E.truncation_error(cells, blocks, RECTS)))


@register("energy_spectrum", sql(SV, "SELECT k, m, sum(energy) AS energy FROM cells GROUP BY k, m", "k:l m:l energy:d"))
def energy_spectrum(spark, sf):
    return tidy(E.energy_spectrum(_decomposition(spark, sf)[2]))


GRID = f"""{SV}, sp AS (SELECT k, m, sum(energy) AS e FROM cells GROUP BY k, m), bl AS (SELECT k, sum(energy) AS e FROM blocks GROUP BY k),
grid AS (SELECT a.k + 1 AS k_extent, a.m + 1 AS m_extent, (SELECT sum(e) FROM sp b WHERE b.k <= a.k AND b.m <= a.m) AS kept, (SELECT sum(e) FROM bl b WHERE b.k <= a.k) AS reached, (SELECT sum(e) FROM bl) AS total FROM sp a),
rho AS (SELECT k_extent, m_extent, sqrt(greatest(total - kept, 0) / total) AS rho, sqrt(greatest(total - reached, 0) / total) AS rho_k, sqrt(greatest(reached - kept, 0) / total) AS rho_m FROM grid)"""


@register("rho_grid", sql(GRID, "SELECT k_extent, m_extent, rho, CASE WHEN rho_k < 1e-5 THEN 0 ELSE rho_k END AS rho_k, rho_m FROM rho", "k_extent:l m_extent:l rho:d rho_k:d rho_m:d"))
def rho_grid(spark, sf):
    _, _, cells, blocks = _decomposition(spark, sf)
    grid = E.rho_grid(E.energy_spectrum(cells), blocks)
    return tidy(grid.withColumn("rho_k", F.when(c("rho_k") < 1e-5, 0.0).otherwise(c("rho_k"))))


def _frontier(where: str, order: str) -> str:
    return f"""SELECT k_extent, m_extent, components, rho FROM (
  SELECT *, min(rho) OVER (ORDER BY components, rho ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM (
    SELECT *, k_extent * m_extent AS components, row_number() OVER (PARTITION BY k_extent ORDER BY m_extent {order}) AS i FROM rho WHERE {where}) WHERE i = 1) WHERE least IS NULL OR rho < least"""


@register("suggest_rectangles", sql(GRID, _frontier("k_extent * m_extent <= 20", "DESC"), "k_extent:l m_extent:l components:l rho:d"))
def suggest_rectangles(spark, sf):
    _, _, cells, blocks = _decomposition(spark, sf)
    return tidy(E.suggest_rectangles(E.rho_grid(E.energy_spectrum(cells), blocks), max_components=20).drop("rho_k", "rho_m"))


@register("suggest_by_error", sql(GRID, _frontier("rho <= 0.7", ""), "k_extent:l m_extent:l components:l rho:d"))
def suggest_by_error(spark, sf):
    _, _, cells, blocks = _decomposition(spark, sf)
    return tidy(E.suggest_rectangles(E.rho_grid(E.energy_spectrum(cells), blocks), max_error=0.7).drop("rho_k", "rho_m"))


TOP = f"""{SV}, ranked AS (SELECT k, m, row_number() OVER (ORDER BY abs(s) DESC, k DESC, m DESC) AS i FROM s),
mirrored AS (SELECT i, 0 AS j, k, m FROM ranked WHERE i <= 9 UNION ALL SELECT i, 1, -k, m FROM ranked WHERE i <= 9 AND k > 0),
top AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS rank, k, m FROM mirrored)"""


@register("top_components", sql(TOP, "SELECT rank, k, m FROM top WHERE rank < 9", "rank:l k:l m:l"))
def top_components(spark, sf):
    return tidy(E.top_components(A.singular_values(spark, sf), 9))


@register("to_sparse", sql(TOP, "SELECT p, f.k, f.m, re, im FROM features f JOIN ranked r ON f.k = r.k AND f.m = r.m WHERE i <= 9", "p:l k:l m:l re:d im:d"))
def to_sparse(spark, sf):
    return tidy(E.to_sparse(A.features(spark, sf).drop("label"), A.singular_values(spark, sf), 9).select("p", "k", "m", "re", "im"))


@register("to_dense", sql(TOP, "SELECT p, f.k, f.m, CASE WHEN i <= 9 THEN re ELSE 0 END AS re, CASE WHEN i <= 9 THEN im ELSE 0 END AS im FROM features f JOIN ranked r ON f.k = r.k AND f.m = r.m", "p:l k:l m:l re:d im:d"))
def to_dense(spark, sf):
    return tidy(E.to_dense(E.to_sparse(A.features(spark, sf).drop("label"), A.singular_values(spark, sf), 9), A.K, A.M, "p"))


@register("gather_pairs", sql(TOP, "SELECT t.k, t.m, f.p, re, CASE WHEN t.k < 0 THEN -im ELSE im END AS im FROM top t JOIN features f ON abs(t.k) = f.k AND t.m = f.m WHERE rank < 9", "k:l m:l p:l re:d im:d"))
def gather_pairs(spark, sf):
    return tidy(E.gather(E.top_components(A.singular_values(spark, sf), 9), A.features(spark, sf).select("p", "k", "m", "re", "im")))


@register("gather_outer", sql(f"{SV}, want AS (SELECT k, m FROM (SELECT unnest(range(-5, 6)) AS k), (SELECT unnest(range(0, 3)) AS m))", "SELECT w.k, w.m, coalesce(s.s, 0) AS s FROM want w LEFT JOIN s ON abs(w.k) = s.k AND w.m = s.m", "k:l m:l s:d"))
def gather_outer(spark, sf):
    want = spark.range(33).select((F.floor(c("id") / 3) - 5).alias("k"), F.pmod("id", F.lit(3)).alias("m"))
    s = A.singular_values(spark, sf).select("k", "m", c("s").alias("re"), F.lit(0.0).alias("im"))
    return tidy(E.gather(want, s, outer=True).select("k", "m", c("re").alias("s")))


@register("reconstruct_polar", sql(
    WEIGHTS + """, vh AS (SELECT k, m, CAST(label AS BIGINT) AS r, avg(im) AS re, avg(re) AS im FROM features GROUP BY k, m, label),
queries AS (SELECT n_nationkey AS q, n_nationkey % 10 AS n, 0.1 * n_nationkey AS psi FROM nation),
radial AS (SELECT q, psi, w.k, r, sum(w.re * v.re - w.im * v.im) AS fr, sum(w.re * v.im + w.im * v.re) AS fi FROM queries JOIN weights w USING (n) JOIN vh v ON w.k = v.k AND w.m = v.m GROUP BY q, psi, w.k, r)""",
    "SELECT q, a, r, sum((CASE WHEN k = 0 THEN 1 ELSE 2 END) * (fr * cos(2 * pi() * k * a / 12 + k * psi) - fi * sin(2 * pi() * k * a / 12 + k * psi)) / sqrt(12)) AS value FROM radial, (SELECT unnest(range(0, 12)) AS a) GROUP BY q, a, r",
    "q:l a:l r:l value:d"))
def reconstruct_polar(spark, sf):
    vh = A.features(spark, sf).groupBy("k", "m", c("label").cast("long").alias("r")).agg(F.avg("im").alias("re"), F.avg("re").alias("im"))
    q = A.table(spark, sf, "nation").select(c("n_nationkey").alias("q"), F.pmod("n_nationkey", F.lit(10)).cast("long").alias("n"), (0.1 * c("n_nationkey")).alias("psi"))
    return tidy(E.reconstruct_polar(q, A.weights(spark, sf), vh, 12))


# hypotheses


@register("decode_hypotheses", sql("ids AS (SELECT l_orderkey % 49 - 1 AS g FROM lineitem)", "SELECT CASE WHEN g < 0 THEN -1 ELSE g // 24 END AS plane, CASE WHEN g < 0 THEN -1 ELSE (g // 12) % 2 END AS filter, CASE WHEN g < 0 THEN -1 ELSE g % 12 END AS orientation, count(*) AS n FROM ids GROUP BY ALL", "plane:l filter:l orientation:l n:l"))
def decode_hypotheses(spark, sf):
    g = A.table(spark, sf, "lineitem").select((F.pmod("l_orderkey", F.lit(49)) - 1).alias("g"))
    got = H.decode(c("g"), 2, 12)
    return tidy(g.select(*(v.alias(k) for k, v in got.items())).groupBy("plane", "filter", "orientation").agg(F.count("*").alias("n")))


SELECTED = """chosen AS (SELECT g AS global_id, g // 24 AS plane, g % 24 AS n FROM (SELECT unnest(range(0, 72)) AS g) WHERE g // 24 IN (0, 2) AND (g % 24) % 3 = 0),
selected AS (SELECT row_number() OVER (ORDER BY plane, n) - 1 AS virtual_id, global_id, plane, n FROM chosen)"""


def _selected(spark):
    h = H.space(spark, 3, 2, 12)
    return H.select_hypotheses(h, planes=[0, 2], templates=h.where(F.pmod("n", F.lit(3)) == 0))


@register("select_hypotheses", sql(SELECTED, "SELECT *, virtual_id // 5 AS batch FROM selected", "virtual_id:l global_id:l plane:l n:l batch:l"))
def select_hypotheses(spark, sf):
    return tidy(H.batches(_selected(spark), 5))


@register("virtual_to_global", sql(SELECTED, "SELECT best_virtual, coalesce(global_id, -1) AS global_id, count(*) AS rows_ FROM (SELECT l_orderkey % 20 - 2 AS best_virtual FROM lineitem) LEFT JOIN selected ON best_virtual = virtual_id GROUP BY ALL", "best_virtual:l global_id:l rows_:l"))
def virtual_to_global(spark, sf):
    best = A.table(spark, sf, "lineitem").select((F.pmod("l_orderkey", F.lit(20)) - 2).alias("best_virtual"))
    return tidy(H.virtual_to_global(best, _selected(spark)).groupBy("best_virtual", "global_id").agg(F.count("*").alias("rows_")))


@register("template_rows", sql("o AS (SELECT DISTINCT o_custkey % 12 AS orientation FROM orders WHERE o_custkey % 12 <> 7)", "SELECT f * 12 + orientation AS n, f AS filter, orientation FROM o, (SELECT unnest([0, 1]) AS f)", "n:l filter:l orientation:l"))
def template_rows(spark, sf):
    o = A.table(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(12)).alias("orientation")).where("orientation <> 7").distinct()
    return tidy(H.template_rows(o, [0, 1], 12))


@register("sorted_unique_ids", sql("", "SELECT DISTINCT o_custkey % 97 AS id FROM orders", "id:l"))
def sorted_unique_ids(spark, sf):
    return tidy(H.sorted_unique_ids(A.table(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(97)).alias("id")), 97))


@register("neighborhoods", sql(
    """px AS (SELECT unnest(range(0, 48)) AS pixel), near AS (SELECT DISTINCT pixel, (pixel + d + 48) % 48 AS q FROM px, (SELECT unnest([-1, 0, 1]) AS d)),
cells AS (SELECT DISTINCT pixel // 4 AS cell, q FROM near), o AS (SELECT g AS orientation, g AS ipix FROM (SELECT unnest(range(0, 192)) AS g) WHERE g % 4 = 0 AND g <> 20)""",
    "SELECT DISTINCT cell, f * 192 + orientation AS n FROM cells JOIN o ON q = ipix // 4, (SELECT unnest([0, 1]) AS f)", "cell:l n:l"))
def neighborhoods(spark, sf):
    px = spark.range(48).withColumnRenamed("id", "pixel")
    near = px.select("pixel", F.pmod(c("pixel") + 1, F.lit(48)).alias("neighbor")).union(px.select("pixel", F.pmod(c("pixel") - 1, F.lit(48))))
    o = spark.range(192).where("id <> 20").select(c("id").alias("orientation"), c("id").alias("ipix"))
    return tidy(H.neighborhoods(near, o, level=1, base=2, rings=1, filters=[0, 1], n_orientations=192))


@register("healpix_level", sql("", "SELECT o_orderkey AS ipix FROM orders WHERE o_orderkey % 16 = 0", "ipix:l"))
def healpix_level(spark, sf):
    return tidy(A.table(spark, sf, "orders").select(c("o_orderkey").alias("ipix")).where(H.at_level(c("ipix"), 2)))


@register("unique_rows", sql("", "SELECT vec_id, array_to_string(list_sort(list_distinct([y FOR y IN [CAST(floor(CAST(x AS DOUBLE) * 20) AS BIGINT) FOR x IN embedding] IF y >= 0])), ',') AS ids FROM embeddings", "vec_id:l ids:s"))
def unique_rows(spark, sf):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 20))
    return A.table(spark, sf, "embeddings").select("vec_id", F.array_join(H.unique_rows(v), ",").alias("ids"))


@register("tiles", sql("r AS (SELECT o_custkey % 7 AS cell, o_orderkey AS p, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS i FROM orders)", "SELECT cell, p, i % 32 AS slot, i // 32 AS tile FROM r", "cell:l p:l slot:l tile:l"))
def tiles(spark, sf):
    return tidy(H.tiles(A.table(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(7)).alias("cell"), c("o_orderkey").alias("p")), 32))


@register("psi_degrees", sql("", "SELECT l_linenumber, 360.0 * (l_orderkey % 16) / 16 AS psi, count(*) AS n FROM lineitem GROUP BY ALL", "l_linenumber:l psi:d n:l"))
def psi_degrees(spark, sf):
    return tidy(A.table(spark, sf, "lineitem").select("l_linenumber", H.psi_degrees(F.pmod("l_orderkey", F.lit(16)), 16).alias("psi")).groupBy("l_linenumber", "psi").agg(F.count("*").alias("n")))


# ledger and decisions

PIXELS = """px AS (SELECT l_returnflag AS image_id, CAST(l_orderkey % 48 AS INT) AS row_, CAST(l_partkey % 48 AS INT) AS col_, max(l_extendedprice) AS mip, avg(l_extendedprice) AS mean, greatest(avg(l_extendedprice * l_extendedprice) - avg(l_extendedprice) * avg(l_extendedprice), 0) AS variance,
  sum(l_suppkey) AS supp, sum(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY ALL),
pixels AS (SELECT image_id, row_ * 48 + col_ AS pixel_id, row_ AS "row", col_ AS "col", mip, mean, variance, CASE WHEN n > 1 THEN (mip - mean) / greatest(sqrt(variance), 1e-12) END AS zscore, CAST(supp AS BIGINT) % 36 AS best_index, CAST(supp AS BIGINT) % 16 AS best_psi, value FROM px)"""
LABELLED = PIXELS + """, labelled AS (SELECT *, CASE WHEN zscore IS NULL THEN 1 WHEN zscore > 2.3 THEN 3 WHEN zscore < 1.2 THEN 2 ELSE 1 END AS label FROM pixels)"""
ABSORBED = LABELLED + """, hit AS (SELECT DISTINCT a.image_id, a.pixel_id FROM labelled a JOIN labelled b ON a.image_id = b.image_id AND a.label = 1 AND b.label = 3 AND (a."row" - b."row") * (a."row" - b."row") + (a."col" - b."col") * (a."col" - b."col") <= 4),
absorbed AS (SELECT l.* EXCLUDE (label), CASE WHEN h.pixel_id IS NOT NULL THEN 4 ELSE label END AS label FROM labelled l LEFT JOIN hit h ON l.image_id = h.image_id AND l.pixel_id = h.pixel_id)"""


def _ledger(spark, sf):
    px = A.pixels(spark, sf)
    return L.write_maps(L.new_ledger(px.select("image_id", "pixel_id", "row", "col")), px, 0)


def _labelled(spark, sf):
    led = _ledger(spark, sf)
    accepted = L.plain_label(c("zscore"), 2.3, accept=True, reject=False)
    label = F.when(accepted == L.LABELS["ACCEPTED"], accepted).otherwise(L.plain_label(c("zscore"), 1.2, accept=False))
    return led.withColumn("label", label.cast("tinyint"))


@register("ledger_write", sql(PIXELS, "SELECT image_id, pixel_id, 1 AS label, mip, sqrt(variance) AS sd, zscore, best_index, 0 AS last_stage FROM pixels", "image_id:s pixel_id:l label:l mip:d sd:d zscore:d best_index:l last_stage:l", 5))
def ledger_write(spark, sf):
    return tidy(_ledger(spark, sf).select("image_id", "pixel_id", "label", "mip", L.std(c("variance")).alias("sd"), "zscore", "best_index", "last_stage"), 5)


@register("decide", sql(LABELLED, "SELECT image_id, pixel_id, label FROM labelled", "image_id:s pixel_id:l label:l"))
def decide(spark, sf):
    return tidy(_labelled(spark, sf).select("image_id", "pixel_id", "label"))


@register("absorb_near_accepted", sql(ABSORBED, "SELECT image_id, pixel_id, label FROM absorbed", "image_id:s pixel_id:l label:l"))
def absorb_near_accepted(spark, sf):
    return tidy(L.absorb_near_accepted(_labelled(spark, sf), 2).select("image_id", "pixel_id", "label"))


@register("next_stage_pixels", sql(ABSORBED, "SELECT image_id, pixel_id FROM absorbed WHERE label IN (1, 3)", "image_id:s pixel_id:l"))
def next_stage_pixels(spark, sf):
    return tidy(L.next_stage_pixels(L.absorb_near_accepted(_labelled(spark, sf), 2)).select("image_id", "pixel_id"))


@register("label_counts", sql(ABSORBED + ", names AS (SELECT unnest(range(0, 6)) AS label)", "SELECT i.image_id, n.label, (SELECT count(*) FROM absorbed a WHERE a.image_id = i.image_id AND a.label = n.label) AS pixels FROM (SELECT DISTINCT image_id FROM absorbed) i, names n", "image_id:s label:l pixels:l"))
def label_counts(spark, sf):
    return tidy(L.label_counts(L.absorb_near_accepted(_labelled(spark, sf), 2)).drop("name"))


@register("run_summary", sql(ABSORBED, "SELECT image_id, " + ", ".join(f"count(*) FILTER (label = {v}) AS {k.lower()}" for k, v in L.LABELS.items()) + " FROM absorbed GROUP BY image_id", "image_id:s " + " ".join(f"{k.lower()}:l" for k in L.LABELS)))
def run_summary(spark, sf):
    """What a run reports: pixels of each image by label."""
    out = S.summary(L.absorb_near_accepted(_labelled(spark, sf), 2))
    return tidy(out.select("image_id", *(c(k).alias(k.lower()) for k in L.LABELS)))


@register("ledger_upsert", sql(LABELLED, "SELECT image_id, pixel_id, CASE WHEN pixel_id % 3 = 0 THEN 1 ELSE label END AS label, CASE WHEN pixel_id % 3 = 0 THEN mip * 2 ELSE mip END AS mip, CASE WHEN pixel_id % 3 = 0 THEN 1 ELSE 0 END AS last_stage, CASE WHEN pixel_id % 3 = 0 THEN NULL WHEN pixel_id % 2 = 0 THEN value END AS score FROM labelled", "image_id:s pixel_id:l label:l mip:d last_stage:l score:d", 5))
def ledger_upsert(spark, sf):
    px = A.pixels(spark, sf)
    led = L.set_values(_labelled(spark, sf), px.where("pixel_id % 2 = 0").select("image_id", "pixel_id", "value"), "score")
    out = L.write_maps(led, px.where("pixel_id % 3 = 0").withColumn("mip", c("mip") * 2), 1)
    return tidy(out.select("image_id", "pixel_id", "label", "mip", "last_stage", "score"), 5)


@register("correlation_scale", sql(PIXELS, "SELECT image_id, quantile_disc(sqrt(variance), 0.5) AS scale FROM pixels GROUP BY image_id", "image_id:s scale:d", 5))
def correlation_scale(spark, sf):
    return tidy(L.correlation_scale(_ledger(spark, sf)), 5)


EXCHANGE = PIXELS + """, sc AS (SELECT image_id, quantile_disc(sqrt(variance), 0.5) AS scale FROM pixels GROUP BY image_id)"""


def _decoded(led):
    return led.withColumn("psi", H.psi_degrees(c("best_psi"), 16)).withColumn("theta", c("best_index") * 5.0).withColumn("phi", c("best_index") * 10.0).withColumn("defocus", F.floor(c("best_index") / 12) * 0.1)


@register("exchange_maps", sql(EXCHANGE, "SELECT image_id, pixel_id, mip / scale AS mip, coalesce(zscore, 0) AS scaled_mip, mean / scale AS correlation_average, sqrt(variance) / scale AS correlation_variance, 22.5 * best_psi AS orientation_psi, best_index * 5.0 AS orientation_theta, best_index * 10.0 AS orientation_phi, (best_index // 12) * 0.1 AS relative_defocus FROM pixels JOIN sc USING (image_id)", "image_id:s pixel_id:l mip:d scaled_mip:d correlation_average:d correlation_variance:d orientation_psi:d orientation_theta:d orientation_phi:d relative_defocus:d", 5))
def exchange_maps(spark, sf):
    return tidy(L.exchange_maps(_decoded(_ledger(spark, sf))).drop("row", "col"), 5)


PICKED = LABELLED + """, cand AS (SELECT * FROM labelled WHERE label IN (1, 3) AND zscore IS NOT NULL),
covered AS (SELECT DISTINCT a.image_id, a.pixel_id FROM cand a JOIN cand b ON a.image_id = b.image_id AND (b.zscore > a.zscore OR (b.zscore = a.zscore AND b.pixel_id < a.pixel_id)) AND (a."row" - b."row") * (a."row" - b."row") + (a."col" - b."col") * (a."col" - b."col") <= 9),
peaks AS (SELECT c.* FROM cand c LEFT JOIN covered v ON c.image_id = v.image_id AND c.pixel_id = v.pixel_id WHERE v.pixel_id IS NULL),
owner AS (SELECT a.image_id, a.pixel_id, p.pixel_id AS peak, row_number() OVER (PARTITION BY a.image_id, a.pixel_id ORDER BY (a."row" - p."row") * (a."row" - p."row") + (a."col" - p."col") * (a."col" - p."col"), p.pixel_id) AS i
  FROM labelled a JOIN peaks p ON a.image_id = p.image_id AND a.label = 3 AND (a."row" - p."row") * (a."row" - p."row") + (a."col" - p."col") * (a."col" - p."col") <= 144),
picked AS (SELECT DISTINCT p.* FROM peaks p JOIN owner o ON p.image_id = o.image_id AND p.pixel_id = o.peak AND o.i = 1)"""


@register("pick_particles", sql(PICKED, "SELECT image_id, pixel_id, zscore FROM picked", "image_id:s pixel_id:l zscore:d", 4))
def pick_particles(spark, sf):
    return tidy(L.pick_particles(_labelled(spark, sf), 3).select("image_id", "pixel_id", "zscore"), 4)


@register("particle_table", sql(PICKED + ", sc AS (SELECT image_id, quantile_disc(sqrt(variance), 0.5) AS scale FROM pixels GROUP BY image_id)", """SELECT row_number() OVER (ORDER BY image_id, pixel_id) - 1 AS particle_index, image_id, "row" AS pos_y, "col" AS pos_x, "row" + 4 AS pos_y_img, "col" + 4 AS pos_x_img, ("row" + 4) * 1.5 AS pos_y_img_angstrom, mip / scale AS mip, zscore AS scaled_mip, 22.5 * best_psi AS psi, label, 0 AS stage FROM picked JOIN sc USING (image_id)""", "particle_index:l image_id:s pos_y:l pos_x:l pos_y_img:l pos_x_img:l pos_y_img_angstrom:d mip:d scaled_mip:d psi:d label:l stage:l", 4))
def particle_table(spark, sf):
    led = _labelled(spark, sf)
    out = L.particle_table(L.exchange_maps(_decoded(led)), L.pick_particles(led, 3), (8, 8), 1.5, 36 * 16)
    return tidy(out.select("particle_index", "image_id", "pos_y", "pos_x", "pos_y_img", "pos_x_img", "pos_y_img_angstrom", "mip", "scaled_mip", "psi", "label", "stage"), 4)


def _poly(values, x):
    return " + ".join(f"({v!r}) * power({x}, {i})" for i, v in enumerate(values))


def _ratio(part, x):
    top, below = L.QUANTILE[part]
    return f"({_poly(top, x)}) / ({_poly(below, x)})"


AUTO = PIXELS + """, counted AS (SELECT image_id, count(*) AS n_pixels, count(*) * 3.0 * 12 * 16 AS tests FROM pixels GROUP BY image_id),
tails AS (SELECT *, sqrt(ln(tests)) AS r FROM counted)"""


@register("auto_thresholds", sql(AUTO, f"SELECT image_id, n_pixels, CASE WHEN r <= 5 THEN {_ratio('middle', '(r - 1.6)')} ELSE {_ratio('tail', '(r - 5.0)')} END AS threshold FROM tails", "image_id:s n_pixels:l threshold:d"))
def auto_thresholds(spark, sf):
    """Each image's threshold by its own positions, as a stage takes it: 3 planes, 12 templates, 16 angles."""
    led = L.new_ledger(A.pixels(spark, sf).select("image_id", "pixel_id", "row", "col"))
    counts = led.groupBy("image_id").count()
    searcher = S.Searcher(None, [], 3, 12, None, None)
    got = searcher.with_threshold(led.select("image_id").distinct(), S.Stage(((0, 0, 1, 1),), 16), counts)
    return tidy(got.join(counts, "image_id").select("image_id", c("count").alias("n_pixels"), c("_threshold").alias("threshold")))


@register("resume", sql("done AS (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag = 'R')", "SELECT l_returnflag AS image_id, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN (SELECT l_returnflag FROM done) GROUP BY ALL", "image_id:s n:l"))
def resume(spark, sf):
    li = A.table(spark, sf, "lineitem")
    done = li.where("l_returnflag = 'R'").select(c("l_returnflag").alias("image_id")).distinct()
    return tidy(li.select(c("l_returnflag").alias("image_id")).join(done, "image_id", "left_anti").groupBy("image_id").agg(F.count("*").alias("n")))


# threshold test

SCALES = """curves AS (SELECT l_returnflag AS image_id, l_linenumber % 3 AS plane, l_suppkey % 16 AS f, (l_suppkey % 16) * sqrt(2) / 2 / 15 AS freq, avg(l_discount) AS noise, avg(l_tax) AS signal FROM lineitem GROUP BY ALL),
tab AS (SELECT p_size % 10 AS n, p_partkey % 16 AS f, avg(p_retailprice) / 1e3 AS rec_auto, avg(p_retailprice) / 2e3 AS res_auto, avg(p_retailprice) / 3e3 AS rec_res, avg(p_size) AS sig_rec, avg(p_size) / 9 AS sig_res FROM part GROUP BY ALL),
sums AS (SELECT image_id, plane, n, sum(noise * rec_auto) AS q_kept, sum(noise * res_auto) AS q_res, sum(noise * rec_res) AS q_cross, sum(signal * exp(-50.0 * (freq / 1.5) * (freq / 1.5) / 4) * sig_rec) AS g_kept, sum(signal * exp(-50.0 * (freq / 1.5) * (freq / 1.5) / 4) * sig_res) AS g_res FROM curves JOIN tab USING (f) GROUP BY ALL),
sc AS (SELECT image_id, plane, n, q_kept, CASE WHEN q_kept > 0 THEN q_cross / q_kept ELSE 0 END AS lam, CASE WHEN g_kept + g_res > 0 THEN least(greatest(g_res / (g_kept + g_res), 0), 1 - 1e-6) ELSE 0 END AS rho, q_res FROM sums),
sd AS (SELECT *, greatest(q_res - lam * lam * q_kept, 0) AS q_perp FROM sc), scales AS (SELECT sd.*, qbar_perp FROM sd JOIN (SELECT image_id, avg(q_perp) AS qbar_perp FROM sd WHERE plane IN (0, 1) AND n < 5 GROUP BY image_id) USING (image_id))"""


def _scales(spark, sf):
    li, part = A.table(spark, sf, "lineitem"), A.table(spark, sf, "part")
    f = F.pmod("l_suppkey", F.lit(16))
    curves = li.groupBy(c("l_returnflag").alias("image_id"), F.pmod("l_linenumber", F.lit(3)).alias("plane"), f.alias("f")).agg(F.avg("l_discount").alias("noise"), F.avg("l_tax").alias("signal")).withColumn("freq", c("f") * (math.sqrt(2) / 2 / 15))
    tab = part.groupBy(F.pmod("p_size", F.lit(10)).alias("n"), F.pmod("p_partkey", F.lit(16)).alias("f")).agg((F.avg("p_retailprice") / 1e3).alias("rec_auto"), (F.avg("p_retailprice") / 2e3).alias("res_auto"), (F.avg("p_retailprice") / 3e3).alias("rec_res"), F.avg("p_size").alias("sig_rec"), (F.avg("p_size") / 9).alias("sig_res"))
    return T.scales(curves, tab, 1.5, 50.0, rows=tab.where("n < 5").select("n"), planes=[0, 1])


@register("noise_scales", sql(SCALES, "SELECT image_id, plane, n, q_kept, q_perp, lam, rho, qbar_perp FROM scales", "image_id:s plane:l n:l q_kept:d q_perp:d lam:d rho:d qbar_perp:d"))
def noise_scales(spark, sf):
    return tidy(_scales(spark, sf))


@register("threshold_distance", sql(
    PIXELS + ", " + SCALES + """, z AS (SELECT p.image_id, p.pixel_id, mip / 1e5 AS mip, mean / 1e5 AS mean, variance / 1e10 AS variance, best_index % 3 AS plane, best_index % 10 AS n, 0.5 + value / 1000 AS level FROM pixels p),
d AS (SELECT z.*, q_kept, q_perp, lam, rho, qbar_perp, mip - mean AS x, rho / (1 - rho) AS a FROM z JOIN scales s ON z.image_id = s.image_id AND z.plane = s.plane AND z.n = s.n)""",
    "SELECT image_id, pixel_id, CAST((mean + 2.5 * 1.1 * sqrt(greatest(variance + level * qbar_perp, 0)) - (mean + x / (1 - rho))) / sqrt(greatest((a - lam) * (a - lam) * level * q_kept + level * q_perp + (0.1 * a * x) * (0.1 * a * x), 1e-30)) AS FLOAT) AS score FROM d",
    "image_id:s pixel_id:l score:d", 3))
def threshold_distance(spark, sf):
    px = A.pixels(spark, sf).withColumn("mip", c("mip") / 1e5).withColumn("mean", c("mean") / 1e5).withColumn("variance", c("variance") / 1e10)
    px = px.withColumn("plane", F.pmod("best_index", F.lit(3))).withColumn("n", F.pmod("best_index", F.lit(10)))
    levels = px.select("image_id", (c("row") + 3).alias("row"), (c("col") + 3).alias("col"), (0.5 + c("value") / 1000).alias("level"))
    return tidy(T.score(px, levels, _scales(spark, sf), T.Calibration(zeta=1.1, eps_rho=0.1), 2.5, (8, 8)).select("image_id", "pixel_id", "score"), 3)


# images

TINY = """tiny AS (SELECT vec_id AS image_id, CAST(i // 8 AS INT) AS "row", CAST(i % 8 AS INT) AS "col", CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i)),
dft AS (SELECT image_id, ky, kx, sum(value * cos(2 * pi() * (((ky * "row") % 8) + ((kx * "col") % 8)) / 8.0)) AS re, sum(-value * sin(2 * pi() * (((ky * "row") % 8) + ((kx * "col") % 8)) / 8.0)) AS im FROM tiny, (SELECT unnest(range(0, 8)) AS ky), (SELECT unnest(range(0, 5)) AS kx) GROUP BY ALL)"""
BINS = """grid AS (SELECT ky, kx, sqrt(power((CASE WHEN ky < 4 THEN ky ELSE ky - 8 END) / 8.0, 2) + power(kx / 8.0, 2)) AS radius, CASE WHEN kx IN (0, 4) THEN 1.0 ELSE 2.0 END AS hw FROM (SELECT unnest(range(0, 8)) AS ky), (SELECT unnest(range(0, 5)) AS kx)),
gr AS (SELECT *, CAST(ceil(round(radius / (sqrt(2) / 2 / 5), 9)) AS INT) AS rr FROM grid), g2 AS (SELECT *, least(rr, 5) AS hi, greatest(least(rr - 1, 5), 0) AS lo FROM gr),
g3 AS (SELECT *, CASE WHEN lo = hi THEN 0 ELSE (radius - lo * (sqrt(2) / 2 / 5)) / (sqrt(2) / 2 / 5) END AS t FROM g2),
bins AS (SELECT ky, kx, f, sum(w) AS weight FROM (SELECT ky, kx, lo AS f, (1 - t) * hw / 64 AS w FROM g3 UNION ALL SELECT ky, kx, hi, t * hw / 64 FROM g3) GROUP BY ky, kx, f)"""
AMPLITUDE = TINY + ", " + BINS + """, amp AS (SELECT image_id, f, f * sqrt(2) / 2 / 5 AS freq, sqrt(sum((CASE WHEN ky = 0 AND kx = 0 THEN 0 ELSE re * re + im * im END) * weight) / sum(weight)) AS amplitude FROM dft JOIN bins USING (ky, kx) GROUP BY image_id, f)"""
CURVES = AMPLITUDE + """, inv AS (SELECT *, CASE WHEN amplitude = 0 THEN 0 ELSE 1 / amplitude END AS v FROM amp),
curve AS (SELECT image_id, f, freq, CASE WHEN freq > 0.5 THEN 1.0 ELSE v / max(CASE WHEN freq <= 0.5 THEN v END) OVER (PARTITION BY image_id) END AS curve FROM inv),
av AS (SELECT f, min(freq) AS freq, sqrt(avg(amplitude * amplitude)) AS amplitude FROM amp GROUP BY f),
avc AS (SELECT f, CASE WHEN freq > 0.5 THEN 1.0 ELSE (CASE WHEN amplitude = 0 THEN 0 ELSE 1 / amplitude END) / (SELECT max(CASE WHEN amplitude = 0 THEN 0 ELSE 1 / amplitude END) FROM av WHERE freq <= 0.5) END AS avg_curve FROM av)"""


@register("dft", sql(TINY, "SELECT * FROM dft", "image_id:l ky:l kx:l re:d im:d"))
def dft(spark, sf):
    return tidy(I.naive_dft(A.tiny_images(spark, sf), 8, 8, ["image_id"]))


def _spectra(spark, sf):
    return I.spectra(I.image_rows(A.tiny_images(spark, sf), 8, 8), 8, 8)


@register("dft_kernel", sql(TINY, "SELECT * FROM dft", "image_id:l ky:l kx:l re:d im:d"))
def dft_kernel(spark, sf):
    return tidy(_spectra(spark, sf))


@register("radial_bins", sql(BINS, "SELECT f, sum(weight) AS weight, count(*) AS cells FROM bins WHERE weight <> 0 GROUP BY f", "f:l weight:d cells:l"))
def radial_bins(spark, sf):
    return tidy(I.radial_bins(spark, 8, 8, 6).groupBy("f").agg(F.sum("weight").alias("weight"), F.count("*").alias("cells")))


@register("amplitude_spectrum", sql(AMPLITUDE, "SELECT * FROM amp", "image_id:l f:l freq:d amplitude:d"))
def amplitude_spectrum(spark, sf):
    return tidy(I.amplitude_spectrum(_spectra(spark, sf), 8, 8, 6))


@register("average_spectrum", sql(CURVES, "SELECT f, freq, amplitude FROM av", "f:l freq:d amplitude:d"))
def average_spectrum(spark, sf):
    return tidy(I.average_spectrum(I.amplitude_spectrum(_spectra(spark, sf), 8, 8, 6)))


@register("whitening_curve", sql(CURVES, "SELECT image_id, f, curve FROM curve", "image_id:l f:l curve:d", 5))
def whitening_curve(spark, sf):
    return tidy(I.whitening_curve(I.amplitude_spectrum(_spectra(spark, sf), 8, 8, 6)).select("image_id", "f", "curve"), 5)


@register("correction_curve", sql(CURVES, "SELECT image_id, f, CASE WHEN avg_curve = 0 THEN 1 ELSE curve / avg_curve END AS correction FROM curve JOIN avc USING (f)", "image_id:l f:l correction:d", 5))
def correction_curve(spark, sf):
    return tidy(I.correction_curve(I.amplitude_spectrum(_spectra(spark, sf), 8, 8, 6)).select("image_id", "f", "correction"), 5)


@register("curve_to_grid", sql(
    CURVES + ", gg AS (SELECT ky, kx, CAST(floor(round(radius / (sqrt(2) / 2 / 5), 9)) AS INT) AS lo, radius / (sqrt(2) / 2 / 5) AS pos FROM grid)",
    "SELECT c.image_id, ky, kx, CASE WHEN d.curve IS NULL AND pos - lo >= 1e-9 THEN 1 ELSE c.curve + greatest(pos - lo, 0) * (coalesce(d.curve, c.curve) - c.curve) END AS value FROM gg JOIN curve c ON c.f = lo LEFT JOIN curve d ON d.image_id = c.image_id AND d.f = lo + 1",
    "image_id:l ky:l kx:l value:d", 5))
def curve_to_grid(spark, sf):
    return tidy(I.curve_to_grid(I.whitening_curve(I.amplitude_spectrum(_spectra(spark, sf), 8, 8, 6)), 8, 8, 6), 5)


@register("normalise_images", sql(TINY, 'SELECT image_id, "row" AS r, "col" AS k, (value - avg(value) OVER (PARTITION BY image_id)) / stddev_samp(value) OVER (PARTITION BY image_id) AS value FROM tiny', "image_id:l r:l k:l value:d"))
def normalise_images(spark, sf):
    return tidy(I.normalise(A.tiny_images(spark, sf)).select("image_id", c("row").alias("r"), c("col").alias("k"), "value"))


@register("disk_mean", sql(TINY, 'SELECT a.image_id, a."row" AS r, a."col" AS k, avg(b.value) AS value FROM tiny a JOIN tiny b ON a.image_id = b.image_id AND (a."row" - b."row") * (a."row" - b."row") + (a."col" - b."col") * (a."col" - b."col") <= 4 GROUP BY ALL', "image_id:l r:l k:l value:d"))
def disk_mean(spark, sf):
    return tidy(I.disk_mean(A.tiny_images(spark, sf), 2).select("image_id", c("row").alias("r"), c("col").alias("k"), "value"))


KERNELS = """kern AS (SELECT k, m, dr, dc, cos(0.7 * dr + k) AS re, sin(0.3 * dc + m) AS im FROM (SELECT unnest(range(0, 2)) AS k), (SELECT unnest(range(0, 2)) AS m), (SELECT unnest(range(0, 3)) AS dr), (SELECT unnest(range(0, 3)) AS dc))"""
FEATURIZED = sql(TINY + ", " + KERNELS, 'SELECT image_id, "row" - dr AS r, "col" - dc AS q, k, m, sum(value * re) AS re, sum(-value * im) AS im FROM tiny, kern WHERE "row" - dr BETWEEN 0 AND 5 AND "col" - dc BETWEEN 0 AND 5 GROUP BY ALL', "image_id:l r:l q:l k:l m:l re:d im:d")


@register("featurize_direct", FEATURIZED)
def featurize_direct(spark, sf):
    cell = spark.range(36).select(F.floor(c("id") / 18).cast("int").alias("k"), F.pmod(F.floor(c("id") / 9), F.lit(2)).cast("int").alias("m"), F.pmod(F.floor(c("id") / 3), F.lit(3)).cast("int").alias("dr"), F.pmod("id", F.lit(3)).cast("int").alias("dc"))
    kern = cell.withColumn("re", F.cos(0.7 * c("dr") + c("k"))).withColumn("im", F.sin(0.3 * c("dc") + c("m")))
    return tidy(I.featurize(A.tiny_images(spark, sf), kern, (3, 3), (6, 6)).select("image_id", c("row").alias("r"), c("col").alias("q"), "k", "m", "re", "im"))


@register("featurize_fft", FEATURIZED)
def featurize_fft(spark, sf):
    import numpy as np

    k, m, dr, dc = np.indices((2, 2, 3, 3))
    kern = np.cos(0.7 * dr + k) + 1j * np.sin(0.3 * dc + m)
    out = I.featurize_fft(I.image_rows(A.tiny_images(spark, sf), 8, 8), kern, 8, 8)
    return tidy(out.select("image_id", c("row").alias("r"), c("col").alias("q"), "k", "m", "re", "im"))


@register("grid_mask", sql(PIXELS, 'SELECT image_id, "row" - 4 AS r, "col" - 4 AS k FROM pixels WHERE value > 100 AND "row" BETWEEN 4 AND 44 AND "col" BETWEEN 4 AND 44', "image_id:s r:l k:l"))
def grid_mask(spark, sf):
    m = I.grid_mask(A.pixels(spark, sf).where("value > 100").select("image_id", "row", "col"), (8, 8), (41, 41))
    return tidy(m.select("image_id", c("row").alias("r"), c("col").alias("k")))


@register("scatter", sql("g AS (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS pixel_id)", "SELECT g.pixel_id, coalesce(v.value, -1) AS value FROM g LEFT JOIN (SELECT o_orderkey AS pixel_id, o_totalprice AS value FROM orders) v USING (pixel_id)", "pixel_id:l value:d"))
def scatter(spark, sf):
    """Orders on the grid of all keys up to the largest; keys that no order has are the gaps."""
    v = A.table(spark, sf, "orders").select(c("o_orderkey").alias("pixel_id"), c("o_totalprice").alias("value"))
    grid = v.agg((F.max("pixel_id") + 1).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)).alias("pixel_id"))
    return tidy(I.scatter(grid, v, ["pixel_id"], "value", -1.0))


@register("positions", sql("", "SELECT o_orderkey AS id, o_orderkey // 2000 AS image, (o_orderkey % 2000) // 40 + 2 AS r, o_orderkey % 40 + 3 AS k FROM orders", "id:l image:l r:l k:l"))
def positions(spark, sf):
    got = I.positions(c("o_orderkey"), 50, 40, (2, 3))
    return tidy(A.table(spark, sf, "orders").select(c("o_orderkey").alias("id"), got["image"].alias("image"), got["row"].alias("r"), got["col"].alias("k")))


_LAM = I.wavelength(300.0)
CTF_CHI = f"(pi() * {_LAM!r} * 1e4 * (defocus + abs(ast) * cos(2 * (atan2(fy, fx) - radians(ang + CASE WHEN ast < 0 THEN 90 ELSE 0 END)))) * g2 - 0.5 * pi() * 2.7e7 * {_LAM**3!r} * g2 * g2 + {math.atan(0.07 / math.sqrt(1 - 0.07**2))!r})"


@register("ctf_planes", sql("pl AS (SELECT n_nationkey AS plane, 1.0 + 0.05 * n_nationkey AS defocus, 0.02 * (n_nationkey - 12) AS ast, 7.0 * n_nationkey AS ang FROM nation), gr AS (SELECT ky, kx, fy, fx, (fy * fy + fx * fx) / 2.25 AS g2 FROM (SELECT ky, kx, (CASE WHEN ky < 4 THEN ky ELSE ky - 8 END) / 8.0 AS fy, kx / 8.0 AS fx FROM (SELECT unnest(range(0, 8)) AS ky), (SELECT unnest(range(0, 5)) AS kx)))", f"SELECT plane, ky, kx, -sin({CTF_CHI}) AS value FROM gr, pl", "plane:l ky:l kx:l value:d", 5))
def ctf_planes(spark, sf):
    n = c("n_nationkey")
    planes = A.table(spark, sf, "nation").select(n.alias("plane"), (1.0 + 0.05 * n).alias("defocus"), (0.02 * (n - 12)).alias("astigmatism"), (7.0 * n).alias("angle"))
    return tidy(I.ctf(I.rfft_grid(spark, 8, 8), planes, 1.5), 5)


@register("band_filter", sql("", "SELECT o_orderkey, CASE WHEN r <= 0.3 THEN 1.0 WHEN r >= 0.5 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * (r - 0.3) / 0.2)) END AS value FROM (SELECT o_orderkey, (o_custkey % 800) / 1000.0 AS r FROM orders)", "o_orderkey:l value:d"))
def band_filter(spark, sf):
    return tidy(A.table(spark, sf, "orders").select("o_orderkey", I.band(F.pmod("o_custkey", F.lit(800)) / 1000.0, 0.4, 0.2).alias("value")))


# polar coordinates and orientations

GRIDS = {k: PolarGrid.of_image(k, (48, 48), 16, 40) for k in ("standard", "offset", "spiral")}
_IMG = 'img AS (SELECT DISTINCT "row" AS y, "col" AS x FROM pixels), pol AS (SELECT y, x, sqrt((y - 24.0) * (y - 24.0) + (x - 24.0) * (x - 24.0)) AS rad, CASE WHEN atan2(y - 24.0, x - 24.0) < 0 THEN atan2(y - 24.0, x - 24.0) + 2 * pi() ELSE atan2(y - 24.0, x - 24.0) END AS ang FROM img)'
_G = GRIDS["spiral"]
_POLAR = {
    "standard": "rad / 24 * 16 AS radius_index, ang / (2 * pi()) * 40 AS angle_index FROM pol",
    "offset": "rad / 24 * 16 AS radius_index, (CASE WHEN ang - off < 0 THEN ang - off + 2 * pi() ELSE ang - off END) / (2 * pi()) * 40 AS angle_index FROM (SELECT *, (floor(rad / 24 * 16)::INT % 2) * pi() / 40 AS off FROM pol)",
    "spiral": f"t / {_G.step!r} - 1 AS radius_index, ((ang - {_G.twist!r} * t) - 2 * pi() * floor((ang - {_G.twist!r} * t) / (2 * pi()))) / (2 * pi()) * 40 AS angle_index FROM (SELECT *, ((rad / 24 + 0.3) * (rad / 24 + 0.3) - 0.09) / 2 AS t FROM pol)",
}
_IMAGE = {
    "standard": ("r / 16.0 * 24", "a / 40.0 * 2 * pi()"),
    "offset": ("r / 16.0 * 24", "(a / 40.0 * 2 * pi() + (r % 2) * pi() / 40)"),
    "spiral": (f"24 * (sqrt(0.09 + 2 * (r + 1) * {_G.step!r}) - 0.3)", f"(a / 40.0 * 2 * pi() + {_G.twist!r} * (r + 1) * {_G.step!r})"),
}


def _turn(df: DataFrame) -> DataFrame:
    """Angles just below a full turn are 0, whatever the last bit says."""
    return df.withColumn("angle_index", F.when(F.round("angle_index", 5) >= 40, 0.0).otherwise(c("angle_index")))


for _kind, _grid in GRIDS.items():

    def _forward(spark, sf, grid=_grid):
        px = A.pixels(spark, sf).select(c("row").alias("y"), c("col").alias("x")).distinct()
        r, a = grid.to_polar(c("y").cast("double"), c("x").cast("double"))
        return tidy(_turn(px.select("y", "x", r.alias("radius_index"), a.alias("angle_index"))), 5)

    def _backward(spark, sf, grid=_grid):
        return tidy(grid.polar_table(spark), 5)

    register(f"polar_{_kind}", sql(PIXELS + ", " + _IMG, f"SELECT y, x, radius_index, CASE WHEN round(angle_index, 5) >= 40 THEN 0 ELSE angle_index END AS angle_index FROM (SELECT y, x, {_POLAR[_kind]})", "y:l x:l radius_index:d angle_index:d", 5))(_forward)
    _rad, _ang = _IMAGE[_kind]
    _edges = "CASE WHEN r = 0 THEN 0 ELSE ({0} + {1}) / 2 END".format(_rad, _rad.replace("r + 1", "r")) if _kind == "spiral" else "r * 1.5"
    _outer = "CASE WHEN r = 15 THEN {0} ELSE ({0} + {1}) / 2 END".format(_rad, _rad.replace("r + 1", "r + 2")) if _kind == "spiral" else "(r + 1) * 1.5"
    register(
        f"image_{_kind}",
        sql("cells AS (SELECT a, r FROM (SELECT unnest(range(0, 40)) AS a), (SELECT unnest(range(0, 16)) AS r))", f'SELECT a, r, {_rad} * sin({_ang}) + 24 AS "row", {_rad} * cos({_ang}) + 24 AS "col", sqrt(0.5 * (({_outer}) * ({_outer}) - ({_edges}) * ({_edges})) * 2 * pi() / 40) AS jacobian FROM cells', 'a:l r:l "row":d "col":d jacobian:d', 5),
    )(_backward)


@register("unit_vectors", sql("", "SELECT o_orderkey, sin(radians(th)) * cos(radians(ph)) AS x, sin(radians(th)) * sin(radians(ph)) AS y, cos(radians(th)) AS z FROM (SELECT o_orderkey, o_custkey % 181 AS th, o_orderkey % 360 AS ph FROM orders)", "o_orderkey:l x:d y:d z:d"))
def unit_vector_query(spark, sf):
    x, y, z = unit_vectors(F.pmod("o_custkey", F.lit(181)), F.pmod("o_orderkey", F.lit(360)))
    return tidy(A.table(spark, sf, "orders").select("o_orderkey", x.alias("x"), y.alias("y"), z.alias("z")))


@register("rotation_matrices", sql("", "SELECT n_nationkey, cos(a) * cos(b) * cos(g) - sin(a) * sin(g) AS m00, -cos(a) * cos(b) * sin(g) - sin(a) * cos(g) AS m01, cos(a) * sin(b) AS m02, sin(b) * sin(g) AS m21, cos(b) AS m22 FROM (SELECT n_nationkey, radians(10.0 * n_nationkey) AS a, radians(7.0 * n_nationkey) AS b, radians(3.0 * n_nationkey) AS g FROM nation)", "n_nationkey:l m00:d m01:d m02:d m21:d m22:d"))
def rotation_matrices(spark, sf):
    n = c("n_nationkey")
    m = D.rotation_zyz(10.0 * n, 7.0 * n, 3.0 * n)
    return tidy(A.table(spark, sf, "nation").select("n_nationkey", *(m[i][j].alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 1), (2, 2)))))


# index build


@register("svd_energy", sql(FEATURES, "SELECT k, sum(re * re + im * im) AS energy FROM features GROUP BY k", "k:l energy:d", 4))
def svd_energy(spark, sf):
    """Squares of the singular values per frequency: all of its energy, the check that a factorisation has in SQL."""
    rows = A.features(spark, sf).groupBy(c("p").alias("n"), "k").agg(F.array_sort(F.collect_list(F.struct("m", "re", "im"))).alias("x")).select("n", "k", F.transform("x", lambda x: x["re"]).alias("re"), F.transform("x", lambda x: x["im"]).alias("im"))
    _, s, _ = D.svd_per_frequency(rows, A.M)
    return tidy(s.groupBy("k").agg(F.sum(c("s") * c("s")).alias("energy")), 4)


@register("svd_values", sql(FEATURES, "SELECT p AS n, k, m AS r, re, im FROM features", "n:l k:l r:l re:d im:d", 4))
def svd_values(spark, sf):
    """The factors multiplied again: every value of every frequency's matrix."""
    rows = A.features(spark, sf).groupBy(c("p").alias("n"), "k").agg(F.array_sort(F.collect_list(F.struct("m", "re", "im"))).alias("x")).select("n", "k", F.transform("x", lambda x: x["re"]).alias("re"), F.transform("x", lambda x: x["im"]).alias("im"))
    u, s, vh = D.svd_per_frequency(rows, A.M)
    w = C.weights_of(u, s).select("n", "k", "m", c("re").alias("wr"), c("im").alias("wi"))
    j = w.join(vh.select("k", "m", "r", c("re").alias("vr"), c("im").alias("vi")), ["k", "m"])
    return tidy(j.groupBy("n", "k", "r").agg(F.sum(c("wr") * c("vr") - c("wi") * c("vi")).alias("re"), F.sum(c("wr") * c("vi") + c("wi") * c("vr")).alias("im")), 4)


@register("healpix_neighbors", sql("px AS (SELECT unnest(range(0, 4)) AS i)", """SELECT DISTINCT pixel, neighbor FROM (
    SELECT i AS pixel, unnest([(i + 1) % 4, (i + 2) % 4, (i + 3) % 4, 4 + i, 4 + (i + 1) % 4, 8 + i]) AS neighbor FROM px UNION ALL
    SELECT 4 + i, unnest([i, (i + 3) % 4, 8 + i, 8 + (i + 3) % 4, 4 + (i + 1) % 4, 4 + (i + 3) % 4]) FROM px UNION ALL
    SELECT 8 + i, unnest([8 + (i + 1) % 4, 8 + (i + 2) % 4, 8 + (i + 3) % 4, 4 + i, 4 + (i + 1) % 4, i]) FROM px)""", "pixel:l neighbor:l"))
def healpix_neighbors(spark, sf):
    """Of the twelve base pixels: four round either pole and four on the equator between them."""
    return tidy(healpix.neighbors(spark, 1))


@register("group_errors", sql(ERRORS, "SELECT n % 4 AS part, sqrt(sum(angular_loss + eigen_loss) / sum(energy)) AS error FROM errors GROUP BY 1 UNION ALL SELECT NULL, sqrt(sum(angular_loss + eigen_loss) / sum(energy)) FROM errors", "part:l error:d"))
def group_errors(spark, sf):
    """One fact table by part and in total, in one pass: grouping sets."""
    _, _, cells, blocks = _decomposition(spark, sf)
    errors = E.truncation_error(cells, blocks, RECTS).withColumn("part", F.pmod("n", F.lit(4)))
    return tidy(errors.rollup("part").agg(E.ratio(F.sum(c("angular_loss") + c("eigen_loss")), F.sum("energy")).alias("error")))


@register("arrivals_best", sql("", "SELECT user_id, max(value) AS best, min(CASE WHEN value = mx THEN event_id END) AS event_id, count(*) AS n, avg(value) AS mean FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS mx FROM events) GROUP BY user_id", "user_id:l best:d event_id:l n:l mean:d"))
def arrivals_best(spark, sf):
    from tessella.streaming.arrivals import running_best

    return tidy(running_best(A.table(spark, sf, "events"), "user_id", "value", "event_id"))


@register("frequency_axis", sql("", "SELECT f, f * sqrt(2) / 2 / 32 AS freq FROM (SELECT unnest(range(0, 33)) AS f)", "f:l freq:d"))
def frequency_axis(spark, sf):
    return tidy(I.frequency_axis(spark, 33))


@register("parseval_weights", sql(FEATURES, "SELECT k, sum(CASE WHEN k IN (0, 3) THEN 1.0 ELSE 2.0 END * re * re) AS e FROM features GROUP BY k", "k:l e:d"))
def parseval_weights(spark, sf):
    return tidy(A.features(spark, sf).groupBy("k").agg(F.sum(E.parseval_weight(c("k"), 6) * c("re") * c("re")).alias("e")))




# the search by bands


BANDED = TINY + ", " + KERNELS + """, y0 AS (SELECT image_id, "row" - dr AS r, "col" - dc AS q, k, m, sum(value * re) AS re, sum(-value * im) AS im FROM tiny, kern WHERE "row" - dr BETWEEN 0 AND 5 AND "col" - dc BETWEEN 0 AND 5 GROUP BY ALL),
features AS (SELECT image_id * 36 + r * 6 + q AS p, k, m, re, im FROM y0), emb AS (SELECT label, i // 8 AS k, i % 8 AS m, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings, (SELECT unnest(range(0, 32)) AS i)),
weights AS (SELECT CAST(label AS BIGINT) AS n, k, m, avg(re) AS re, avg(im) AS im FROM emb WHERE k < 2 AND m < 2 GROUP BY label, k, m)"""


def _cells(rects):
    import numpy as np

    from tessella.operators import bands as B

    index = sorted({(k, m) for k0, m0, ke, me in rects for k in range(k0, k0 + ke) for m in range(m0, m0 + me)})
    dr, dc = np.indices((3, 3))
    return B.Cells(tuple(index), np.stack([np.cos(0.7 * dr + k) + 1j * np.sin(0.3 * dc + m) for k, m in index]))


class _TinyEngine:
    """The stage work on embeddings as 8 x 8 images under 3 x 3 kernels; templates are the labels' means."""

    def __init__(self, spark, sf, digits=None):
        from tessella.operators import bands as B
        from tessella.operators.prepared import Optics

        rows = I.image_rows(A.tiny_images(spark, sf), 8, 8).select("image_id", F.lit(8).alias("h"), F.lit(8).alias("w"), "data")
        self.bands, self.weights, self.B, self.digits = B.plane_bands(rows, None, Optics(), (3, 3), 4), A.weights(spark, sf), B, digits

    def maps(self, pixels, stage):
        import numpy as np

        cells = _cells(stage.rectangles)
        block = C.weight_block(self.weights.where(C.in_rectangles(stage.rectangles)), *cells.extent)
        stats = self.B.stage_stats(self.bands, pixels, cells, self.B.Block(np.arange(len(block)), block), stage.n_psi, 4, 16, 8, 4, None, (6, 6), (8, 8), self.digits)
        return self.B.merged_blocks(stats, len(block) * stage.n_psi).withColumn("best_index", c("best_virtual").cast("long"))


def _tiny_positions(spark, sf):
    at = F.explode(F.sequence(F.lit(0), F.lit(35))).alias("pixel_id")
    return A.table(spark, sf, "embeddings").select(c("vec_id").alias("image_id"), at).select("image_id", c("pixel_id").cast("long").alias("pixel_id"), F.floor(c("pixel_id") / 6).cast("int").alias("row"), F.pmod("pixel_id", F.lit(6)).cast("int").alias("col"))


@register("search_bands", sql(BANDED + ", " + search_sql(8), f"SELECT p // 36 AS image_id, p % 36 AS pixel_id, mip, best_virtual, best_psi, mean, variance, zscore FROM ({SEARCHED})", "image_id:l pixel_id:l mip:d best_virtual:l best_psi:l mean:d variance:d zscore:d"))
def search_bands(spark, sf):
    """One stage over all positions of all images, as the search program does it."""
    out = _TinyEngine(spark, sf, digits=6).maps(_tiny_positions(spark, sf), S.Stage(((0, 0, 2, 2),), 8))
    return tidy(out.select("image_id", "pixel_id", "mip", "best_virtual", "best_psi", "mean", "variance", "zscore"))


def _zscores_sql(name: str, cells: str, n_psi: int) -> str:
    """(p, z) of a stage over the cells of a condition, unrounded."""
    angle = f"2 * pi() * k * psi / {n_psi}"
    return f"""s_{name} AS (SELECT y.p, w.n, y.k, sum(y.re * w.re + y.im * w.im) AS cr, sum(y.im * w.re - y.re * w.im) AS ci FROM features y JOIN weights w ON y.k = w.k AND y.m = w.m AND {cells} GROUP BY y.p, w.n, y.k),
c_{name} AS (SELECT p, n, psi, sum(CASE WHEN k = 0 THEN cr ELSE 2 * (cr * cos({angle}) - ci * sin({angle})) END) AS c FROM s_{name}, (SELECT unnest(range(0, {n_psi})) AS psi) GROUP BY p, n, psi),
{name} AS (SELECT p, (max(c) - avg(c)) / greatest(sqrt(greatest(avg(c * c) - avg(c) * avg(c), 0)), 1e-12) AS z FROM c_{name} GROUP BY p)"""


STAGED = f"""{BANDED}, {_zscores_sql('z1', 'y.m < 1', 4)}, {_zscores_sql('z2', 'y.m < 2', 8)},
labels AS (SELECT z1.p, z1.z AS za, z2.z AS zb, CASE WHEN z1.z < 2.0 THEN 2 WHEN z2.z > 2.6 THEN 3 ELSE 1 END AS label FROM z1 JOIN z2 ON z1.p = z2.p)"""


@register("search_stages", sql(STAGED, "SELECT p // 36 AS image_id, p % 36 AS pixel_id, label, CASE WHEN label = 2 THEN 0 ELSE 1 END AS last_stage, CASE WHEN label = 2 THEN za ELSE zb END AS zscore FROM labels", "image_id:l pixel_id:l label:l last_stage:l zscore:d", 4))
def search_stages(spark, sf):
    """Two stages over one ledger: few cells and angles reject, all cells accept among what is left."""
    stages = [S.Stage(((0, 0, 2, 1),), 4, decision=S.Decision(2.0, accept=False)), S.Stage(((0, 0, 2, 2),), 8, decision=S.Decision(2.6, reject=False))]
    cut = lambda df, name: df.persist()  # noqa: E731  a short lineage
    led = S.Searcher(None, stages, 1, 10, None, cut, engine=_TinyEngine(spark, sf)).run(L.new_ledger(_tiny_positions(spark, sf)))
    return tidy(led.select("image_id", "pixel_id", "label", "last_stage", "zscore"), 4)
