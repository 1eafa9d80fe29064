"""The shared folder: given by the session, or made up on a local master alone."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from geoledger import storage


def session(master, given=None):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: given), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(session(master))
    assert storage.shared_dir(session(master, "s3a://bucket/x/")) == "s3a://bucket/x/app-1"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_master_makes_its_own(master):
    assert storage.shared_dir(session(master)).endswith("/app-1")
