import pytest

from geotrail import Bounds, PartitionParams
from geotrail.operators import models, sample
from geotrail.plans import inputs as i
from geotrail.sources import points as source
from geotrail.sources import positions, store, workload


def test_parameters_must_be_positive():
    for bad in ({"time_window": 0}, {"node_capacity": -1}, {"sample_size": 0}, {"max_depth": 0}, {"max_depth": 30}):
        given = {"bounds": i.BOUNDS, "time_window": 1, "node_capacity": 1, "sample_size": 1} | bad
        with pytest.raises(ValueError):
            PartitionParams(**given)
    assert PartitionParams(i.BOUNDS, 1, 1, 1).max_depth is None
    with pytest.raises(ValueError):
        Bounds(0, 0, 0, 1)


def test_arguments_are_checked_before_a_plan(spark, sf_dir):
    points = i.points(spark, sf_dir)
    for call in (
        lambda: models.build_grid(spark, i.BOUNDS, 0, 3),
        lambda: models.build_quadtree(points, i.BOUNDS, 0),
        lambda: models.build_kdtree(points, i.BOUNDS, -1),
        lambda: models.build_strtree(points, i.BOUNDS, 0),
        lambda: sample.sample_trajectories(points, 0),
        lambda: source.replicate(points, 0),
        lambda: source.set_partitions(points, 0),
        lambda: source.read_trajectories(spark, " "),
        lambda: workload.read_workload(spark, None),
        lambda: positions.skip_rows(points, -1),
        lambda: store.read_store(spark, ""),
        lambda: store.write_store(points, None, 1, "p", layout="heap"),
    ):
        with pytest.raises(ValueError):
            call()


def test_missing_path_is_reported(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        source.read_trajectories(spark, str(tmp_path / "missing")).count()


def test_a_cluster_needs_the_shared_folder(spark):
    from geotrail import scratch

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(values)

    with pytest.raises(ValueError):
        scratch.scratch_dir(Session(**{"spark.master": "yarn"}), "x")
    shared = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch.scratch_dir(shared, "x").startswith("hdfs:///shared/x-")
