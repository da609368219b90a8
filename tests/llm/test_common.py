from types import SimpleNamespace

import pyarrow as pa
import pytest

from docassay.llm.common import pieces, shared_folder, spans


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, folder=None):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: folder or default))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(master))
    assert shared_folder(session(master, "hdfs:///x")) == "hdfs:///x"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_local_mode_takes_a_temporary_folder(master):
    assert "spark-checkpoint-" in shared_folder(session(master))
    assert shared_folder(session(master, "/named")) == "/named"


def test_pieces_keep_rows_and_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 900, 30, 2000, 1, 1)]), pa.array(range(7))], names=["t", "n"])
    got = list(pieces([batch, batch.slice(0, 0)], 1000))
    assert [x for b in got for x in b.column(1).to_pylist()] == list(range(7))
    assert all(b.nbytes <= 1000 or b.num_rows == 1 for b in got) and len(got) < 9


@pytest.mark.parametrize("sizes,want", [([], []), ([9], [(0, 1)]), ([3, 3, 3, 3], [(0, 3), (3, 4)]), ([0, 0, 50, 1, 9], [(0, 2), (2, 3), (3, 5)])])
def test_spans(sizes, want):
    assert [(s.start, s.stop) for s in spans(sizes, 10)] == want
