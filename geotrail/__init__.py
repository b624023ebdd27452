"""geotrail: spatio-temporal range queries over trajectories, as Spark DataFrame jobs.

Points live in a long table ``traj_id, x, y, t``. A spatial model cuts the plane into
regions, a time window cuts time into blocks, and ``(loc, block)`` keys every point.
"""

from geotrail.params import Bounds, BoxQuery, CircleQuery, PartitionParams

__all__ = ["Bounds", "BoxQuery", "CircleQuery", "PartitionParams"]
