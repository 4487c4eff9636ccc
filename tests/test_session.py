"""The shared folder: read from the session, refused on a cluster without one."""

from types import SimpleNamespace

import pytest

from firmlens.session import checkpoint_dir


def stand_in(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_configured_folder_is_used():
    assert checkpoint_dir(stand_in("yarn", "hdfs://host/shared/")) == "hdfs://host/shared"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,1024]", "spark://host:7077", "k8s://host"])
def test_cluster_without_folder_is_refused(master):
    with pytest.raises(RuntimeError):
        checkpoint_dir(stand_in(master))
