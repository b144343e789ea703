"""The shared work folder."""

from types import SimpleNamespace

import pytest

from keepwell import session


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder),
                           sparkContext=SimpleNamespace(master=master, applicationId="app-" + master))


def test_the_cluster_names_the_folder():
    assert session.shared_folder(fake("yarn", "hdfs:///work/")) == "hdfs:///work"


def test_a_cluster_without_one_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))


def test_a_local_session_gets_one_folder():
    first = session.shared_folder(fake("local[2]"))
    assert first == session.shared_folder(fake("local[2]")) and "keepwell" in first
