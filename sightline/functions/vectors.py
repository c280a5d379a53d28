"""Vector and box column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    scale = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x.cast("double") / scale)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def valid_box(box: Column) -> Column:
    """Box of exactly four numbers, else null."""
    numbers = F.transform(box, lambda v: v.try_cast("double"))
    return F.when((F.size(box) == 4) & ~F.exists(numbers, lambda v: v.isNull()), numbers)


def _finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def sort_corners(box: Column) -> Column:
    """Left, top, right, bottom in rising order; null when short or not finite."""
    b = F.transform(box, lambda v: v.cast("double"))
    ordered = F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))
    return F.when((F.size(box) >= 4) & _finite(F.slice(b, 1, 4)), ordered)


def polygon_box(points: Column) -> Column:
    """Smallest box around a polygon given as an array of points."""
    good = F.filter(points, lambda p: F.size(p) >= 2)
    xs = F.transform(good, lambda p: p[0].cast("double"))
    ys = F.transform(good, lambda p: p[1].cast("double"))
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(good) > 0, box)


# Picture sizes a detector may have worked on.
CANVASES = [
    (640, 360),
    (854, 480),
    (960, 540),
    (1024, 576),
    (1280, 720),
    (1366, 768),
    (1600, 900),
    (1920, 1080),
    (2560, 1440),
    (3840, 2160),
]


def fit_box(box: Column, width: Column, height: Column) -> Column:
    """Fit a box to its picture.

    Raw box if inside; else the first known canvas (smallest scale) that explains it; else cut to the picture.
    """

    def explain(r: Column) -> Column:
        b, w, h = r["b"], r["w"], r["h"]

        def scale_of(canvas: Column) -> Column:
            return (canvas["w"] / w + canvas["h"] / h) / 2.0

        def explains(canvas: Column) -> Column:
            sx, sy, scale = canvas["w"] / w, canvas["h"] / h, scale_of(canvas)
            covers = (canvas["w"] >= w) & (canvas["h"] >= h) & (b[2] <= canvas["w"]) & (b[3] <= canvas["h"])
            alike = (F.abs(sx - sy) <= 0.05) & (F.abs(canvas["w"] / canvas["h"] - w / h) <= 0.05)
            return covers & alike & (scale > 1.0) & (b[2] / scale <= w) & (b[3] / scale <= h)

        scales = F.transform(F.filter(canvases, explains), scale_of)
        may_scale = (b[0] >= 0.0) & (b[1] >= 0.0) & (F.greatest(b[2] / w, b[3] / h) >= 1.2)
        return F.struct(b.alias("b"), w.alias("w"), h.alias("h"), F.when(may_scale, F.array_min(scales)).alias("scale"))

    def fit(r: Column) -> Column:
        b, w, h = r["b"], r["w"], r["h"]

        def cut(v: Column, hi: Column) -> Column:
            return F.greatest(F.lit(0.0), F.least(hi, v))

        inside = (b[0] >= 0.0) & (b[1] >= 0.0) & (b[2] <= w) & (b[3] <= h)
        return (
            F.when((w <= 0) | (h <= 0) | inside, b)
            .when(r["scale"].isNotNull(), F.transform(b, lambda v: v / r["scale"]))
            .when(b.isNotNull(), F.array(cut(b[0], w), cut(b[1], h), cut(b[2], w), cut(b[3], h)))
        )

    sizes = [F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for w, h in CANVASES]
    canvases = F.array(*sizes)
    read = {"b": sort_corners(box), "w": width.cast("double"), "h": height.cast("double")}
    return let({"r": let(read, explain)}, lambda x: fit(x["r"]))
