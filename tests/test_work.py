"""The shared folder: tables are written there, and steps leave only their results."""

import pytest

from kindred.sources import work


class Context:
    """A cluster's context without a checkpoint folder."""

    master = "spark://host:7077"
    _jsc = property(lambda self: self)

    def getConf(self):
        return {}

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isEmpty(self):
        return True


class Session:
    sparkContext = Context()
    conf = {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work.shared_dir(Session())


def test_settled_steps_leave_their_result(spark):
    made = []

    def make():
        first = work.materialize(spark.range(10), "first")
        made.extend(first.inputFiles())
        return first.where("id > 3")

    out = work.settle(spark, make, "step")
    assert out.count() == 6
    path = made[0].removeprefix("file://")
    with pytest.raises(FileNotFoundError):
        open(path, "rb")
