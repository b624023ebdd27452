"""Small fixtures and comparisons shared by the tests."""

from geotrail.operators import models
from geotrail.plans import inputs as i

POINT_SCHEMA = "traj_id string, x double, y double, t bigint"

EDGE_POINTS = [
    ("rim", 3.0, 4.0, 10),  # on the rim of the circle (0, 0), r 5
    ("edge", 4.0, 8.0, 10),  # on a cell edge
    ("upper", 1024.0, 5.0, 10),  # on the upper bound: outside
    ("far", 5000.0, -7.0, 10),
    ("negative", 5.0, 5.0, -5),
    ("twice", 6.0, 6.0, 30),
    ("twice", 7.0, 6.0, 30),
    ("twice", 6.0, 6.0, 20),
    ("twice", 900.0, 900.0, 25),
]


def points_of(spark, rows):
    return spark.createDataFrame(rows, POINT_SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def build(kind, spark, points, capacity=i.CAPACITY):
    if kind == "grid":
        return models.build_grid(spark, i.BOUNDS, *i.GRID)
    if kind == "quadtree":
        return models.build_quadtree(points, i.BOUNDS, capacity, i.MAX_DEPTH)
    return getattr(models, f"build_{kind}")(points, i.BOUNDS, capacity)


KINDS = ["grid", "quadtree", "kdtree", "strtree"]
