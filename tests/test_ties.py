"""Correlations that are equal when rounded: the smallest hypothesis and angle win in every form, as in the SQL."""

import numpy as np
import pytest

from tessella.operators import bands as B
from tessella.operators import correlate as C


def test_rounding_is_half_away_from_zero():
    x = np.array([0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 2.0**52 + 1, np.inf, -np.inf])
    np.testing.assert_array_equal(C.rounded(x, 0), [1, -1, 2, 3, -3, 0, 2.0**52 + 1, np.inf, -np.inf])
    np.testing.assert_array_equal(C.rounded(np.array([0.1234565000001, -7.00000049, 1e305]), 6), [0.123457, -7.0, 1e305])
    assert np.isnan(C.rounded(np.array([np.nan]), 6)).all()


def test_rounded_maxima_go_to_the_first_of_templates_and_angles():
    w = np.zeros((3, 2, 1), complex)
    w[:, 0, 0] = 1, 1 + 4e-7, 1 + 3e-7
    y = np.zeros((2, 2, 1), complex)
    y[:, 0, 0] = 1, 10  # the second pixel's correlations differ after rounding as well
    for chunk in (1, 2, 3):
        assert C.reduce_block(y, w, 8, chunk)["best_virtual"].tolist() == [1, 1]
        got = C.reduce_block(y, w, 8, chunk, digits=6)
        assert got["best_virtual"].tolist() == [0, 1] and got["best_psi"].tolist() == [0, 0] and got["mip"].tolist() == [1.0, 10.000004]
    w[:, :, 0] = [[0, np.exp(1j * np.pi / 8 * (1 + 1e-7))], [0, 0], [0, 0]]  # angles 0 and 1 are as near as 4e-8
    y[:, :, 0] = [0, 1]
    assert C.reduce_block(y, w, 8)["best_psi"].tolist() == [7, 7] and C.reduce_block(y, w, 8, digits=6)["best_psi"].tolist() == [0, 0]


@pytest.fixture(scope="module")
def near_ties(tmp_path_factory):
    """Embeddings of ten labels, the second as good as the first but for the last bit of its numbers."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(3).normal(size=(10, 64)).astype(np.float32) / 10
    x[1] = np.nextafter(x[0], np.float32(np.inf) * np.sign(x[0]))
    folder = tmp_path_factory.mktemp("ties")
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(pa.table({"vec_id": range(10), "embedding": x.tolist(), "label": range(10)}, kinds), folder / "embeddings.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import __spark_entry__ as e

    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        want = con.execute(e.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, e.queries()[name](spark, folder).collect())) == sorted(want)


def test_arrow_form_against_sql(spark, near_ties):
    same_as_sql(spark, near_ties, "correlate_arrow")


def test_bands_give_rounded_maxima_to_the_first_template():
    rng = np.random.default_rng(4)
    w = np.repeat(rng.normal(size=(1, 3, 2)) + 1j * rng.normal(size=(1, 3, 2)), 4, 0) * (1 + 1e-9 * np.arange(4))[:, None, None]
    y = rng.normal(size=(7, 3, 2)) + 1j * rng.normal(size=(7, 3, 2))
    near = {0: np.array([1, 2]), 1: np.array([2, 3])}
    block = B.Block(np.array([5, 6, 8, 9]), w, near, B.Forms(w, 12))
    group = np.arange(7) % 2
    plain, local = (B.reduce_band(y, g, b, 12, 2, 3, digits=6) for g, b in ((None, B.Block(block.rows, w)), (group, block)))
    assert plain["best_virtual"].tolist() == [5] * 7 and local["best_virtual"].tolist() == np.array([6, 8])[group].tolist()
    exact = B.reduce_band(y, None, B.Block(block.rows, w), 12, 2, 3)
    assert exact["best_virtual"].tolist() == [9] * 7
    np.testing.assert_array_equal(plain["mip"], C.rounded(exact["mip"], 6))
    for s in ("s1", "s2"):
        np.testing.assert_array_equal(plain[s], exact[s])
        np.testing.assert_allclose(local[s], exact[s])


def test_bands_against_sql(spark, near_ties):
    same_as_sql(spark, near_ties, "search_bands")
