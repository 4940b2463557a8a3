"""GeoTIFF files by byte ranges: layouts, windows that leave blocks unread, metadata from headers, tiles written by tasks."""

import numpy as np
import pytest

from geostrata.sources import gtiff


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(5).normal(size=(2, 300, 410)).astype(np.float32).astype(float)


@pytest.mark.parametrize("big", [False, True])
def test_tiled_round_trip(spark, tmp_path, values, big):
    values = values.copy()
    values[0, 3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(gtiff.encode_tiled(values, 10.0, 20.0, 0.5, 32637, tile=64, big=big))
    for band in (1, 2):
        got = gtiff.decode((tmp_path / "a.tif").read_bytes(), band)[0]
        assert np.array_equal(np.where(got == -9999, np.nan, got), values[band - 1], equal_nan=True)
    cells = gtiff.read_cells(spark, str(tmp_path / "a.tif"), 2, task_bytes=5 * 64 * 64 * 8).toPandas()
    dense = np.full(values.shape[1:], np.nan)
    dense[cells["row"], cells["col"]] = cells["value"]
    assert np.array_equal(dense, values[1]) and len(cells) == dense.size
    assert gtiff.read_cells(spark, str(tmp_path / "a.tif")).where("value is null").count() == 1
    meta = gtiff.read_meta(spark, str(tmp_path)).first()
    assert (meta.width, meta.height, meta.bands, meta.x_min, meta.y_min, meta.pixel_size, meta.epsg, meta.nodata, meta.error) == (410, 300, 2, 10.0, 20.0, 0.5, 32637, -9999.0, None)


def test_a_window_reads_its_blocks_only(values):
    body = gtiff.encode_tiled(values, 0.0, 0.0, 1.0, tile=64)
    seen = []

    def read(at, n):
        seen.append((at, n))
        return body[at : at + n]

    tiff = gtiff.parse(read)
    assert sum(n for _, n in seen) < 3 * gtiff.HEAD_BYTES < len(body) / 50  # a header reads no pixels
    reader = gtiff._Reader({"path": ""})
    reader.low |= {"row": 100, "col": 70}
    reader.high |= {"row": 120, "col": 130}
    blocks = [tiff.block(int(k)) for k in reader._wanted(tiff)]
    assert sorted(b[:2] for b in blocks) == [(128, 64), (128, 128), (192, 64), (192, 128)]  # rows 179 to 199 from the north


def test_filters_reach_the_source(spark, tmp_path, values):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tif").write_bytes(gtiff.encode_tiled(values, 0.0, 0.0, 1.0, tile=64))
    cells = gtiff.read_cells(spark, str(tmp_path), 1, task_bytes=64 * 64 * 8)
    window = cells.where("row >= 100 AND row <= 120 AND col > 69 AND col < 131")
    assert window.rdd.getNumPartitions() == 8 and cells.rdd.getNumPartitions() == 2 * 5 * 7
    got = window.where("path like '%a.tif'").toPandas()
    assert len(got) == 21 * 61 and np.allclose(got["value"], values[0][got["row"], got["col"]])
    assert cells.where("row > 5000").count() == 0


def test_a_bad_file_has_its_error_in_the_metadata(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    (tmp_path / "cut.tif").write_bytes(gtiff.encode(np.zeros((4, 4)), 0.0, 0.0, 1.0)[:60])
    (tmp_path / "good.tif").write_bytes(gtiff.encode(np.zeros((4, 5)), 0.0, 0.0, 1.0))
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.error is None) for r in gtiff.read_meta(spark, str(tmp_path)).collect()}
    assert got == {"bad.tif": (None, False), "cut.tif": (None, False), "good.tif": (5, True)}


def test_tiles_written_by_tasks(spark, tmp_path, values):
    rows = [(i, j, float(values[0, i, j])) for i in range(0, 300, 7) for j in range(0, 410, 3) if j < 64 or j > 200]
    cells = spark.createDataFrame(rows, "row int, col int, value double")
    written = gtiff.write_tiles(cells, str(tmp_path / "out"), 5.0, 6.0, 2.0, 300, 410, tile=128).collect()
    assert sum(r.n for r in written) == len(rows) and len(written) == 3 * 4
    meta = {r.path: r for r in gtiff.read_meta(spark, str(tmp_path / "out")).collect()}
    assert all(m.x_min == 5 + 2 * 128 * int(p[-10:-4]) and m.y_min == 6 + 2 * 128 * int(p[-17:-11]) for p, m in meta.items())
    back = gtiff.read_cells(spark, str(tmp_path / "out")).where("value is not null").collect()
    found = {(r.row + 128 * int(r.path[-17:-11]), r.col + 128 * int(r.path[-10:-4])): r.value for r in back}
    assert found == {(i, j): v for i, j, v in rows}
