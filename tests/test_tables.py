"""Where intermediate tables go."""

import pytest

from tessera.functions.tables import shared_folder


class Session:
    """Only what the choice of the folder reads."""

    def __init__(self, master, **settings):
        self.settings, self.master = settings, master

    @property
    def conf(self):
        return self

    sparkContext = conf

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_a_cluster_never_gets_a_local_folder():
    def folder(master, warehouse, **more):
        return shared_folder(Session(master, **{"spark.sql.warehouse.dir": warehouse}, **more))

    assert folder("local[4]", "file:/w") == "file:/w/tessera-shared"
    assert folder("spark://a:7077", "hdfs://b/w") == "hdfs://b/w/tessera-shared"
    assert folder("spark://a:7077", "file:/w", **{"spark.checkpoint.dir": "s3a://c/d"}) == "s3a://c/d"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError):
            folder("spark://a:7077", warehouse)
