import struct
import zlib

import numpy as np
import pytest

from annomatrix import AnnotatedMatrix
from annomatrix.plotting import PcaPlotSettings, plot_pca, raster
from annomatrix.plotting.scatter import MARGIN

W, H, ALPHA = 140, 130, 0.3


def pixels(path):
    data = open(path, "rb").read()
    w, h = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


@pytest.mark.parametrize("size", [1, 3])
def test_every_point_is_drawn(spark, tmp_path, size):
    rng = np.random.default_rng(5)
    spots = np.vstack([rng.integers(0, 9, (300, 2)), [[0, 0]] * 40, [[8, 8]]]).astype(float)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(spots)] + [(len(spots), [float("nan"), 1.0])]
    emb = spark.createDataFrame(rows, "obs_idx long, vec array<double>").repartition(5)
    x = spark.createDataFrame([(0, 0, 1.0)], "obs_idx long, var_idx long, value double")
    obs = emb.selectExpr("obs_idx", "cast(obs_idx % 2 as string) as side")
    am = AnnotatedMatrix(x, obs, x.select("var_idx"), obsm={"X_pca": emb})
    style = PcaPlotSettings().with_dimensions(W, H).with_point_size(size).with_point_color((0, 0, 255), ALPHA)
    path = str(tmp_path / "p.png")
    colors = plot_pca(am, path, "side", style)
    w, h, r = W - 2 * MARGIN, H - 2 * MARGIN, size - 1
    img = np.empty((H, W, 3))
    img[:] = style.background
    place = lambda v, n: int(np.floor(v / 8 * (n - 1)))
    order = sorted((str(i % 2), place(a, w), place(b, h)) for i, (a, b) in enumerate(spots))
    for side, cx, cy in order:  # one point at a time
        px, py = MARGIN + cx, MARGIN + h - 1 - cy
        area = img[max(0, py - r) : py + r + 1, max(0, px - r) : px + r + 1]
        area[:] = area * (1 - ALPHA) + np.array(colors[side]) * ALPHA
    inside = (slice(MARGIN + r, MARGIN + h - r), slice(MARGIN + r, MARGIN + w - r))
    assert np.abs(pixels(path)[inside].astype(int) - img[inside].astype(np.uint8).astype(int)).max() <= 1


def test_raster_counts(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 0.0, 5.0), ("b", 1.0, 5.0), (None, 1.0, float("inf")), ("b", None, 5.0), (None, 0.5, 5.0)], "l string, x double, y double")
    got = {tuple(r) for r in raster(df, "x", "y", 11, 4, "l").collect()}
    assert got == {("a", 0, 0, 2), ("b", 10, 0, 1), (None, 5, 0, 1)}
    assert raster(df.limit(0), "x", "y", 11, 4).collect() == []
