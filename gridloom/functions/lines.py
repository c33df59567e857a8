"""Column functions on polylines, array<struct<x,y>>: length, shares along the line, stretches of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import project

POINT = "struct<x:double,y:double>"


def steps(line: Column) -> Column:
    """array<struct<a,b,d,at>>: the line's segments, their lengths and how far along the line each begins."""
    pairs = F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))
    sized = F.transform(pairs, lambda s: F.struct(s.a.alias("a"), s.b.alias("b"), F.sqrt(F.pow(s.a.x - s.b.x, 2) + F.pow(s.a.y - s.b.y, 2)).alias("d")))
    return F.transform(sized, lambda s, i: F.struct(s.a.alias("a"), s.b.alias("b"), s.d.alias("d"), F.aggregate(F.slice(sized, 1, i), F.lit(0.0), lambda t, u: t + u.d).alias("at")))


def length(line: Column) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda t, s: t + s.d)


def interpolate(line: Column, share: Column) -> Column:
    """The point at a share of the line's length, from 0 to 1; null for a line without points."""
    way = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * length(line)
    s = F.try_element_at(F.filter(steps(line), lambda s: (way <= s.at + s.d) & (s.d > 0)), F.lit(1))
    t = (way - s["at"]) / s["d"]
    there = F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t).alias("y"))
    return F.when(s.isNotNull(), there).otherwise(F.try_element_at(line, F.lit(-1)))


def locate(line: Column, x: Column, y: Column) -> Column:
    """The share of the line's length at which it is nearest to a point, the first such; 0 for a line of no length."""

    def near(s: Column) -> Column:
        t = project(x, y, s.a.x, s.a.y, s.b.x, s.b.y)
        dx, dy = x - (s.a.x + t * (s.b.x - s.a.x)), y - (s.a.y + t * (s.b.y - s.a.y))
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("far"), (s.at + t * s.d).alias("way"))

    total = length(line)
    return F.when(total > 0, F.array_min(F.transform(steps(line), near))["way"] / total).otherwise(F.lit(0.0))


def substring(line: Column, start: Column, stop: Column) -> Column:
    """The stretch of the line between two shares of its length, start <= stop."""
    total = length(line)
    inner = F.filter(steps(line), lambda s: (s.at > start * total) & (s.at < stop * total))
    return F.concat(F.array(interpolate(line, start)), F.transform(inner, lambda s: s.a), F.array(interpolate(line, stop)))


def reversed_line(line: Column) -> Column:
    return F.reverse(line)


def same_line(a: Column, b: Column) -> Column:
    """Whether two lines have the same points in one direction or the other."""
    return (a == b) | (a == F.reverse(b))
