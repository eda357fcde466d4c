"""Colour spaces and colour tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published sRGB to CIELAB conversion, and the normalisation of a segmentation model's input.
MATRIX = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
KNEE = 0.008856
#: The linear value of each 8-bit one, by the rule: a look-up keeps the generated code small.
LINEAR = [v / 255.0 / 12.92 if v / 255.0 <= 0.04045 else ((v / 255.0 + 0.055) / 1.055) ** 2.4 for v in range(256)]
PIXEL_MEAN, PIXEL_STD = (123.675, 116.28, 103.53), (58.395, 57.12, 57.375)


def rgb_to_lab(df: DataFrame) -> DataFrame:
    """r, g, b of 0 to 255 (others give null) to L, a, b_ (double). The b of LAB is named b_ beside the b of RGB."""
    linear = [F.get(F.lit(LINEAR), F.col(c).cast("int")) for c in "rgb"]
    xyz = [sum((m * c for m, c in zip(row, linear, strict=True)), F.lit(0.0)) / w for row, w in zip(MATRIX, WHITE, strict=True)]
    rows = df.withColumns(dict(zip(("__x", "__y", "__z"), xyz, strict=True)))
    f = {c: F.when(F.col(c) > KNEE, F.pow(F.col(c), F.lit(1.0 / 3))).otherwise(7.787 * F.col(c) + 16.0 / 116) for c in ("__x", "__y", "__z")}
    light = F.when(F.col("__y") > KNEE, 116 * f["__y"] - 16).otherwise(903.3 * F.col("__y"))
    return rows.withColumns({"L": light, "a": 500 * (f["__x"] - f["__y"]), "b_": 200 * (f["__y"] - f["__z"])}).drop("__x", "__y", "__z")


def _byte(c: Column) -> Column:
    return F.least(F.greatest(F.round(c), F.lit(0.0)), F.lit(255.0)).cast("int")


def lab_encode8(df: DataFrame) -> DataFrame:
    """L, a, b_ to L8, A8, B8 of 0 to 255; a fixed-point library may differ by 1."""
    return df.withColumns({"L8": _byte(F.col("L") * 255 / 100), "A8": _byte(F.col("a") + 128), "B8": _byte(F.col("b_") + 128)})


def lab_decode8(df: DataFrame, cols: tuple[str, str, str] = ("L", "A", "B")) -> DataFrame:
    """Site colours of 8 bits to water_l, water_a, water_b."""
    light, a, b = cols
    return df.withColumns({"water_l": F.col(light) * 100.0 / 255, "water_a": F.col(a) - 128.0, "water_b": F.col(b) - 128.0})


def distance(light: str = "L", a: str = "a", b: str = "b_") -> Column:
    """Euclidean LAB distance to water_l, water_a, water_b."""
    return F.sqrt(sum((F.pow(F.col(x) - F.col(w), F.lit(2.0)) for x, w in ((light, "water_l"), (a, "water_a"), (b, "water_b"))), F.lit(0.0)))


def water_pixels(df: DataFrame, threshold: float = 20) -> DataFrame:
    """Pixels within the threshold of the water colour, with their dist."""
    return df.withColumn("dist", distance()).where(F.col("dist") <= threshold)


def distance_map(df: DataFrame, threshold: float = 20) -> DataFrame:
    """dist of each pixel, null beyond twice the threshold."""
    return df.withColumn("dist", distance()).withColumn("dist", F.when(F.col("dist") <= 2 * threshold, F.col("dist")))


def off_color(color_threshold: float = 15, lightness: float = 75.0) -> Column:
    """Whether a disputed pixel is dark enough and off the water's hue: it is not water then."""
    hue = F.sqrt(F.pow(F.col("a") - F.col("water_a"), F.lit(2.0)) + F.pow(F.col("b_") - F.col("water_b"), F.lit(2.0)))
    return (F.col("L") < lightness) & (hue > color_threshold)


def validate_color(df: DataFrame, color_threshold: float = 15, lightness: float = 75.0) -> DataFrame:
    return df.withColumn("validated", off_color(color_threshold, lightness))


def normalize_rgb(df: DataFrame) -> DataFrame:
    """r, g, b to nr, ng, nb: the input of a segmentation model."""
    return df.withColumns({f"n{c}": (F.col(c) - m) / s for c, m, s in zip("rgb", PIXEL_MEAN, PIXEL_STD, strict=True)})
