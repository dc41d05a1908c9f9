"""What figures show, as bounded tables made in Spark: sections as pixels, the largest bars, cells of a heat map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_sections(points: DataFrame, by: str = "section", panels: int | None = 12) -> DataFrame:
    """by, x0, y0, side (its square) of the first sections by name, or of all (panels=None); points without finite coordinates do not count."""
    there = points.where("x is not null and y is not null and abs(x) < double('inf') and abs(y) < double('inf')")
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    boxes = there.groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), side.alias("side"))
    return boxes if panels is None else boxes.orderBy(by).limit(panels)


def pixels(points: DataFrame, value: str, width: int = 256, by: str = "section", panels: int | None = None) -> DataFrame:
    """by, px, py, n, value: sections on grids of width x width squares, with the mean of a number or the most frequent text (ties to the least).

    Both axes have one scale, the section's longer side; y grows downwards. A section at one place is one pixel. Null and NaN values are not drawn.
    A section gives width^2 rows at most, whatever its points; they are added up before they are shuffled."""
    boxes = first_sections(points, by, panels).withColumnRenamed(by, "_by")
    p = points.select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).alias("_v"))
    p = p.join(boxes, F.col(by).eqNullSafe(F.col("_by"))).where("_v is not null and x is not null and y is not null and abs(x) < double('inf') and abs(y) < double('inf')")
    at = lambda c: F.when(F.col("side") > 0, F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * width), F.lit(width - 1))).otherwise(0).cast("int").alias(f"p{c}")
    p = p.select(by, at("x"), at("y"), "_v")
    if points.schema[value].dataType.typeName() in ("string", "boolean"):
        counts = p.groupBy(by, "px", "py", F.col("_v").cast("string").alias("_v")).agg(F.count("*").alias("k"))
        out = counts.groupBy(by, "px", "py").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("m"), "_v")).alias("b"))
        return out.select(by, "px", "py", "n", F.col("b._v").alias("value"))
    return p.where(~F.isnan(F.col("_v").cast("double"))).groupBy(by, "px", "py").agg(F.count("*").alias("n"), F.avg("_v").alias("value"))


def largest(rows: DataFrame, name: str, top: int = 25) -> DataFrame:
    """name, n: the most frequent values, ties by name."""
    return rows.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def cells(rows: DataFrame, row: str, column: str, value: str | None = None, most: int = 200) -> DataFrame:
    """row, column, value: means (or counts) of every pair of names, over the `most` most frequent names of either side, ties by name."""
    d = rows.select(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("value"))
    c = d.where("row is not null and column is not null and value is not null and not isnan(value)").groupBy("row", "column").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    for side in ("row", "column"):
        often = c.groupBy(side).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), side).limit(most).select(F.col(side).alias("_name"))
        c = c.join(often, F.col(side) == F.col("_name"), "left_semi")
    return c.select("row", "column", (F.col("s") / F.col("n") if value else F.col("s")).alias("value"))


def row_order(table: DataFrame) -> DataFrame:
    """Rows of cells() with the place of their row and column by name."""
    rank = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1  # noqa: E731  # at most `most` squared rows
    return table.withColumns({"i": rank("row"), "j": rank("column")})
