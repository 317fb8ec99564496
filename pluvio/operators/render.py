"""Image algebra of overlays, as numbers per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.palette import RENDERER_DISTANCE, nearest


def luma(r: Column, g: Column, b: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255.0


def overlay_alpha(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """A radar pixel's alpha in the overlay: 0 unless it shows precipitation."""
    return F.when((alpha <= 10) | (nearest(r, g, b)["d2"] > RENDERER_DISTANCE**2), 0).otherwise(alpha).cast("int")


def dimmed_alpha(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """Dark pixels at a quarter of their alpha, where a confidence map is present."""
    return F.when(luma(r, g, b) >= 0.1, alpha).otherwise(F.floor(alpha * 0.25)).cast("int")


def over(top: Column, alpha: Column, below: Column) -> Column:
    """A channel of a pixel laid over another."""
    return F.round((top * alpha + below * (255 - alpha)) / 255.0).cast("int")


def _grey(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((r * 19595 + g * 38470 + b * 7471 + 32768).cast("int"), 16)


def dark_map(pixels: DataFrame, saturation: float = 0.75) -> DataFrame:
    """``pixels`` (r, g, b) with dark_r, dark_g, dark_b: less saturated, of the same hue, and the
    value turned round, at least as bright as the luma is dark. Works in bytes as image libraries
    do, step by step, so that no step is computed anew for each that uses it."""
    red, green, blue = (F.col(f"_{n}") for n in "rgb")
    d = pixels.withColumn("_grey", _grey(F.col("r"), F.col("g"), F.col("b")))
    d = d.withColumns({f"_{n}": F.floor(F.col("_grey") + (F.col(n) - F.col("_grey")) * saturation) for n in "rgb"})
    d = d.withColumns({"_top": F.greatest(red, green, blue), "_luma": _grey(red, green, blue)})
    d = d.withColumn("_span", (F.col("_top") - F.least(red, green, blue)).cast("double"))
    turn = F.when(red == F.col("_top"), (green - blue) / F.col("_span")).when(green == F.col("_top"), 2.0 + (blue - red) / F.col("_span")).otherwise(4.0 + (red - green) / F.col("_span"))
    colourless = F.col("_span") == 0
    d = d.withColumns({
        "_sector": F.when(colourless, 0.0).otherwise(F.floor(F.pmod(turn / 6.0 + 1.0, F.lit(1.0)) * 255.0)) * 6.0 / 255.0,
        "_sat": F.when(colourless, 0.0).otherwise(F.floor(F.col("_span") / F.col("_top") * 255.0)) / 255.0,
        "_v": F.greatest(255 - F.col("_top"), 255 - F.col("_luma")).cast("int"),
    })
    part = F.col("_sector") - F.floor("_sector")
    d = d.withColumns({n: F.floor(F.col("_v") * (1 - F.col("_sat") * k) + 0.5).cast("int") for n, k in (("_p", F.lit(1.0)), ("_q", part), ("_t", 1 - part))})
    at = F.floor("_sector").cast("int") % 6 + 1
    out = {f"dark_{n}": F.element_at(F.array(*[f"_{x}" for x in six]), at) for n, six in (("r", "vqpptv"), ("g", "tvvqpp"), ("b", "pptvvq"))}
    return d.select(*pixels.columns, *[v.alias(n) for n, v in out.items()])
