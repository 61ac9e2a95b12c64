"""A scatter plot of two components. Spark finds the range and counts the points per pixel and label, so what the
driver draws is bounded by the size of the picture and not by the observations, and dense regions are darker."""

from __future__ import annotations

import colorsys
import math
import struct
import warnings
import zlib

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite
from ..model import AnnotatedMatrix
from .settings import PcaPlotSettings

MARGIN = 40
MAX_LABELS = 64


def plot_range(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row with the range of the finite coordinates: x_min, x_max, y_min, y_max; null without any."""
    ends = [(f"{n}_{f.__name__}", f(finite(F.col(c)))) for n, c in (("x", x), ("y", y)) for f in (F.min, F.max)]
    return points.agg(*[v.alias(n) for n, v in ends])


def raster(points: DataFrame, x: str, y: str, width: int, height: int, *by: str, ends: DataFrame | None = None) -> DataFrame:
    """(by, cx, cy, n): how many points with finite coordinates fall on each pixel, from 0 at the least coordinates. ends is
    plot_range of the points, where it is known already."""
    ends = plot_range(points, x, y) if ends is None else ends
    at = lambda c, o, n: F.floor((finite(F.col(c)) - F.col(f"{o}_min")) / F.coalesce(F.nullif(F.col(f"{o}_max") - F.col(f"{o}_min"), F.lit(0.0)), F.lit(1.0)) * (n - 1)).cast("int")
    placed = points.join(F.broadcast(ends)).select(*by, at(x, "x", width).alias("cx"), at(y, "y", height).alias("cy"))  # one row: an aggregate without keys
    return placed.dropna(subset=["cx", "cy"]).groupBy(*by, "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def _png(path: str, pixels) -> None:
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    text = chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + head + text)


def _drawn(spark: SparkSession, width: int, height: int, texts: list[tuple[str, int, int, int, float, bool]]):
    """How far each pixel is covered by texts: (text, x, y, size, part of its width left of x, upright). The JVM draws
    them; where it has no fonts, a warning says so and nothing is covered."""
    import numpy as np

    awt = spark._jvm.java.awt
    try:
        spark._jvm.java.lang.System.setProperty("java.awt.headless", "true")
        image = awt.image.BufferedImage(width, height, awt.image.BufferedImage.TYPE_BYTE_GRAY)
        g = image.createGraphics()
        for text, x, y, size, left, upright in texts:
            g.setFont(awt.Font("SansSerif", 0, size))
            turned = g.getTransform()
            if upright:
                g.rotate(-math.pi / 2, float(x), float(y))
            g.drawString(text, int(x - left * g.getFontMetrics().stringWidth(text)), y)
            g.setTransform(turned)
        g.dispose()
        cover = np.frombuffer(image.getRaster().getDataBuffer().getData(), dtype="uint8")
    except Py4JError as e:
        warnings.warn(f"the plot has no text, as the JVM draws none: {e}", stacklevel=3)
        cover = np.zeros(width * height, dtype="uint8")
    return cover.reshape(height, width, 1) / 255


def plot_pca(
    am: AnnotatedMatrix, path: str, label: str | None = None, settings: PcaPlotSettings | None = None, key: str = "X_pca"
) -> dict[str, tuple[int, int, int]]:
    """Writes a PNG of two components of an embedding, with title, axis labels and legend, and returns the colour of each label. label names an obs column;
    its distinct values, in sorted order, get evenly spaced hues. Points with a coordinate that is not finite are left
    out; it is an error if none is left, or if there are more than 64 labels."""
    import numpy as np

    s = settings or PcaPlotSettings()
    if key not in am.obsm:
        raise KeyError(f"obsm has no {key}; run pca first")
    a, b = s.axes
    points = am.obsm[key].select("obs_idx", F.get("vec", F.lit(a)).alias("px"), F.get("vec", F.lit(b)).alias("py"))
    if label is not None:
        points = points.join(am.obs.select("obs_idx", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")), "obs_idx")
    else:
        points = points.withColumn("label", F.lit(""))
    ends = plot_range(points, "px", "py").first()
    if ends.x_min is None or ends.y_min is None:
        raise ValueError("there is no finite point to plot")
    w, h = s.width - 2 * MARGIN, s.height - 2 * MARGIN
    known = am.x.sparkSession.createDataFrame([tuple(ends)], "x_min double, x_max double, y_min double, y_max double")
    spots = raster(points, "px", "py", w, h, "label", ends=known)
    labels = [r.label for r in points.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    hue = lambda i: tuple(round(255 * v) for v in colorsys.hsv_to_rgb(i / len(labels), 0.8, 0.85))
    colors = {n: s.point_color if label is None else hue(i) for i, n in enumerate(labels)}

    img = np.empty((s.height, s.width, 3), dtype="float64")
    img[:] = s.background
    ink = [255 - c for c in s.background]
    img[MARGIN : MARGIN + h, MARGIN - 1] = ink
    img[MARGIN + h, MARGIN : MARGIN + w] = ink
    r = max(0, s.point_size - 1)
    for spot in spots.orderBy("label", "cx", "cy").toLocalIterator():
        cx, cy = MARGIN + spot.cx, MARGIN + h - 1 - spot.cy
        area = img[max(0, cy - r) : cy + r + 1, max(0, cx - r) : cx + r + 1]
        alpha = 1 - (1 - s.point_alpha) ** spot.n  # as if each of the n points were drawn
        area[:] = area * (1 - alpha) + np.array(colors[spot.label]) * alpha
    half, step = MARGIN // 2, min(16, max(1, h // max(1, len(labels))))
    texts = [
        (s.title, s.width // 2, half + 6, 16, 0.5, False),
        (s.x_label, s.width // 2, s.height - half + 5, 12, 0.5, False),
        (s.y_label, half + 5, s.height // 2, 12, 0.5, True),
    ]
    if label is not None:
        side = max(1, min(8, step - 1))
        for i, n in enumerate(labels):
            img[MARGIN + step * i : MARGIN + step * i + side, s.width - half : s.width - half + side] = colors[n]
            texts.append((n, s.width - half - 4, MARGIN + step * i + side, max(6, min(11, step)), 1.0, False))
    cover = _drawn(am.x.sparkSession, s.width, s.height, [t for t in texts if t[0]])
    img = img * (1 - cover) + np.array(ink) * cover
    _png(path, img.clip(0, 255).astype("uint8"))
    return colors
