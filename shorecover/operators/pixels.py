"""Pixel tables: samples, histograms, medians, resampling, equalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import first_by_hash
from .survey import order_hash

IMAGE = "image"


def image_sizes(pixels: DataFrame) -> DataFrame:
    """image, height, width: from the largest coordinates."""
    return pixels.groupBy(IMAGE).agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))


def sample_pixels(pixels: DataFrame, n: int = 50_000, seed: int = 0) -> DataFrame:
    """At most n pixels of each image, without repeats, in a reproducible random choice. Only the pixels under a threshold on their hash, about n an image, are ranked. For stored rasters, blocks.sample_colors does it before pixels are rows."""
    return first_by_hash(pixels, [IMAGE], n, order_hash(seed, IMAGE, "y", "x"), ["y", "x"])


def _channels(pixels: DataFrame, by: str, channels: tuple[str, ...]) -> DataFrame:
    """by, channel, v, n: how often each value occurs; at most 256 rows a channel of 8 bits."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("p")
    return pixels.select(by, each).select(by, "p.channel", "p.v").where("v is not null").groupBy(by, "channel", "v").agg(F.count("*").alias("n"))


def _medians(counts: DataFrame, by: str) -> DataFrame:
    """The exact median of each channel from counts of values: the mean of the two middle ones."""
    w = Window.partitionBy(by, "channel")
    rows = counts.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "all": F.sum("n").over(w)})
    low, high = F.expr("(`all` + 1) div 2"), F.expr("`all` div 2 + 1")
    middle = rows.groupBy(by, "channel").agg(F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("b"))
    return middle.select(by, "channel", ((F.col("a") + F.col("b")) / 2).alias("median"))


def site_colors(pixels: DataFrame, by: str = "location", channels: tuple[str, str, str] = ("L8", "A8", "B8")) -> DataFrame:
    """The water colour of each location: the exact median of each 8-bit channel, cut to an integer, as L, A, B.

    Only counts of values are shuffled, at most 768 rows a location and task.
    """
    m = _medians(_channels(pixels, by, channels), by)
    return m.groupBy(by).agg(*[F.max(F.when(F.col("channel") == c, F.col("median").cast("int"))).alias(name) for c, name in zip(channels, "LAB", strict=True)])


def channel_histogram(pixels: DataFrame, bins: int = 32, by: str = "location", channels: tuple[str, ...] = ("L8", "A8", "B8")) -> DataFrame:
    """by, channel, bin, n, median: equal bins between the least and largest value, the last one closed."""
    counts = _channels(pixels, by, channels)
    w = Window.partitionBy(by, "channel")
    rows = counts.withColumns({"lo": F.min("v").over(w), "hi": F.max("v").over(w)})
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return rows.withColumn("bin", at.cast("int")).groupBy(by, "channel", "bin").agg(F.sum("n").alias("n")).join(_medians(counts, by), [by, "channel"])


def downsample(pixels: DataFrame, factor: float, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Area means over blocks of factor x factor pixels, rounded to 0 to 255; the size becomes floor(size / factor).

    A pixel adds to each target pixel by the part of it that lies there; what lies beyond the new
    size is scaled in, as the blocks share the whole image.
    """
    sizes = image_sizes(pixels).withColumns({"nh": F.floor(F.col("height") / factor), "nw": F.floor(F.col("width") / factor)}).where("nh > 0 and nw > 0")
    rows = pixels.join(sizes, IMAGE).withColumns({"fy": F.col("height") / F.col("nh"), "fx": F.col("width") / F.col("nw")})
    near = lambda v, f, n: F.sequence(F.floor(F.col(v) / F.col(f)), F.least(F.ceil((F.col(v) + 1) / F.col(f)) - 1, F.col(n) - 1))
    part = lambda v, f, t: F.least(F.col(v) + 1.0, (F.col(t) + 1) * F.col(f)) - F.greatest(F.col(v) + 0.0, F.col(t) * F.col(f))
    rows = rows.withColumn("ty", F.explode(near("y", "fy", "nh"))).withColumn("tx", F.explode(near("x", "fx", "nw")))
    rows = rows.withColumn("w", part("y", "fy", "ty") * part("x", "fx", "tx")).where("w > 1e-9")
    mean = lambda c: F.round(F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 6)).cast("int").alias(c)
    return rows.groupBy(IMAGE, F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x")).agg(*[mean(c) for c in channels])


def equalize(pixels: DataFrame, value: str = "L8", clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation of an 8-bit channel, as column `equalized`.

    Each of tiles x tiles tiles has a histogram, cut at max(1, floor(clip * pixels / 256)) with the
    excess spread evenly over all bins (the rest of the division is dropped); its running sum maps
    values to 0 to 255. A pixel blends the maps of the four tiles around it linearly.
    """
    sizes = image_sizes(pixels)
    rows = pixels.join(sizes, IMAGE).withColumns({"th": F.ceil(F.col("height") / tiles), "tw": F.ceil(F.col("width") / tiles)})
    own = rows.withColumns({"ty": F.expr("int(y div th)"), "tx": F.expr("int(x div tw)")})
    hist = own.groupBy(IMAGE, "ty", "tx", F.col(value).alias("v")).agg(F.count("*").alias("n"))
    tile = own.groupBy(IMAGE, "ty", "tx").agg(F.count("*").alias("area")).withColumn("cap", F.greatest(F.lit(1), F.floor(clip * F.col("area") / 256)))
    full = tile.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(hist, [IMAGE, "ty", "tx", "v"], "left").na.fill({"n": 0})
    w = Window.partitionBy(IMAGE, "ty", "tx")
    spread = F.floor(F.sum(F.greatest(F.col("n") - F.col("cap"), F.lit(0))).over(w) / 256)
    full = full.withColumn("m", F.least("n", "cap") + spread)
    maps = full.withColumn("s", F.sum("m").over(w.orderBy("v"))).select(IMAGE, "ty", "tx", "v", F.least(F.round(F.col("s") * 255.0 / F.col("area")), F.lit(255.0)).alias("map"))
    last = own.groupBy(IMAGE).agg(F.max("ty").alias("my"), F.max("tx").alias("mx"))
    at = own.join(last, IMAGE).withColumns({"py": (F.col("y") + 0.5) / F.col("th") - 0.5, "px": (F.col("x") + 0.5) / F.col("tw") - 0.5})
    at = at.withColumns({"wy": F.col("py") - F.floor("py"), "wx": F.col("px") - F.floor("px")})
    clamp = lambda p, d, m: F.least(F.greatest(F.floor(p) + d, F.lit(0)), F.col(m)).cast("int")
    corner = lambda dy, dx: F.struct(clamp("py", dy, "my").alias("ty"), clamp("px", dx, "mx").alias("tx"), ((F.col("wy") if dy else 1 - F.col("wy")) * (F.col("wx") if dx else 1 - F.col("wx"))).alias("k"))
    four = at.select(IMAGE, "y", "x", F.col(value).alias("v"), F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("c"))
    four = four.select(IMAGE, "y", "x", "v", "c.ty", "c.tx", "c.k").join(maps, [IMAGE, "ty", "tx", "v"])
    return four.groupBy(IMAGE, "y", "x", "v").agg(F.round(F.sum(F.col("k") * F.col("map"))).cast("int").alias("equalized"))
