from types import SimpleNamespace

import pytest

from tagweave import session


def stub(configured, master, application, checkpoints=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured),
        sparkContext=SimpleNamespace(
            applicationId=application, master=master, getCheckpointDir=lambda: checkpoints
        ),
    )


def test_configured_folder_wins():
    assert session.shared_folder(stub("/shared/x/", "yarn", "a1", "/other")) == "/shared/x"


def test_unset_folder_on_a_cluster_needs_one_set_for_checkpoints():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(stub(None, "yarn", "a2"))
    assert session.shared_folder(stub(None, "yarn", "a2", "/shared/work/")) == "/shared/work"


def test_unset_folder_on_a_local_master_is_temporary():
    cluster_free = stub(None, "local[2]", "a3")
    first = session.shared_folder(cluster_free)
    assert first == session.shared_folder(cluster_free)
    assert session.new_folder(cluster_free, "x") != session.new_folder(cluster_free, "x")
