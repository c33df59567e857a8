"""Meetings of segments and planarisation as DataFrame operations over grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import segments_cross

COORDINATES = ("x1", "y1", "x2", "y2")


def box_cells(a: str, b: str, size: float) -> Column:
    return F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))


def overlapping_boxes(segments: DataFrame, size: float) -> DataFrame:
    """Ordered pairs of different segments (id, x1, y1, x2, y2; the other's with ``o_``) whose boxes overlap.

    Both sides are dealt over the cells of their boxes; a pair is kept in one
    cell only, that of the lower left corner of the common box, so no distinct
    and no second shuffle is needed.  ``size`` should be near the usual length.
    """
    s = segments.select("id", *COORDINATES).where(" and ".join(f"{c} is not null" for c in COORDINATES))
    dealt = s.withColumn("cx", F.explode(box_cells("x1", "x2", size))).withColumn("cy", F.explode(box_cells("y1", "y2", size)))
    other = dealt.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("id", *COORDINATES)])
    low = lambda k: F.greatest(F.least(f"{k}1", f"{k}2"), F.least(f"o_{k}1", f"o_{k}2"))
    high = lambda k: F.least(F.greatest(f"{k}1", f"{k}2"), F.greatest(f"o_{k}1", f"o_{k}2"))
    once = (F.col("cx") == F.floor(low("x") / size)) & (F.col("cy") == F.floor(low("y") / size))
    return dealt.join(other, ["cx", "cy"]).where(F.col("id") != F.col("o_id")).where((low("x") <= high("x")) & (low("y") <= high("y")) & once).drop("cx", "cy")


def crossed(segments: DataFrame, size: float) -> DataFrame:
    """``segments`` (id, x1, y1, x2, y2) that another crosses at a point inside both; of a cell's segments the first that does ends the search."""
    s = segments.select("id", *COORDINATES).where(" and ".join(f"{c} is not null" for c in COORDINATES))
    dealt = s.withColumn("cx", F.explode(box_cells("x1", "x2", size))).withColumn("cy", F.explode(box_cells("y1", "y2", size))).alias("p")
    other = dealt.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in COORDINATES]).alias("q")
    meet = segments_cross(tuple(F.col(c) for c in COORDINATES), tuple(F.col(f"o_{c}") for c in COORDINATES))
    same = (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))
    return dealt.join(other, same & meet, "left_semi").drop("cx", "cy").distinct()


def planarise(segments: DataFrame, size: float) -> DataFrame:
    """Pieces (id, piece from 1, x1, y1, x2, y2) of segments cut wherever another crosses, touches or overlaps them.

    Null coordinates and segments of no length have no pieces; equal segments do
    not cut each other, so their pieces repeat.
    """
    c = F.col
    pairs = overlapping_boxes(segments, size).withColumns({"ux": c("x2") - c("x1"), "uy": c("y2") - c("y1"), "vx": c("o_x2") - c("o_x1"), "vy": c("o_y2") - c("o_y1")})
    pairs = pairs.withColumns({"den": c("ux") * c("vy") - c("uy") * c("vx"), "n": c("ux") * c("ux") + c("uy") * c("uy")})
    wx, wy = c("o_x1") - c("x1"), c("o_y1") - c("y1")
    crossing = F.when((c("den") != 0) & ((wx * c("uy") - wy * c("ux")) / c("den")).between(-1e-9, 1 + 1e-9), (wx * c("vy") - wy * c("vx")) / c("den"))

    def end(k: int) -> Column:
        """Share at which an end of a parallel segment lies on this one."""
        px, py = c(f"o_x{k}") - c("x1"), c(f"o_y{k}") - c("y1")
        return F.when((c("den") == 0) & (F.abs(px * c("uy") - py * c("ux")) <= 1e-9 * c("n")), (px * c("ux") + py * c("uy")) / c("n"))

    cuts = pairs.where("n > 0").select("id", F.explode(F.array(crossing, end(1), end(2))).alias("t")).where("t > 1e-9 and t < 1 - 1e-9")
    cuts = cuts.groupBy("id").agg(F.collect_set(F.round("t", 9)).alias("cuts"))
    own = segments.select("id", *COORDINATES).where("x1 <> x2 or y1 <> y2")
    stops = F.concat(F.array(F.lit(0.0)), F.array_sort(F.coalesce("cuts", F.array().cast("array<double>"))), F.array(F.lit(1.0)))
    out = own.join(cuts, "id", "left").withColumn("stops", stops).select("id", *COORDINATES, "stops", F.explode(F.sequence(F.lit(1), F.size("stops") - 1)).alias("piece"))
    at = lambda k, a, b: F.col(a) + (F.col(b) - F.col(a)) * F.element_at("stops", F.col("piece") + k)
    return out.select("id", "piece", at(0, "x1", "x2").alias("x1"), at(0, "y1", "y2").alias("y1"), at(1, "x1", "x2").alias("x2"), at(1, "y1", "y2").alias("y2"))
