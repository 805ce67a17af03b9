"""Tables in the shared folder."""

import os

import pytest

from lexmill import storage


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master, self.applicationId = master, "app"

    def get(self, name, default):
        return default


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(Elsewhere(master))


def test_written_tables_can_be_dropped(spark):
    df, path = storage.written_at(spark.range(5), "numbers")
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    storage.drop_path(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))
    assert storage.written(spark.range(0), "none").count() == 0
