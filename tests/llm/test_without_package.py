"""What the operators send to the tasks can be loaded where the package is not installed."""

import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from lexivane.llm import queries

SF = "/root/testdata/sf0.001"
NAMES = ["op4_minhash_fingerprints", "op11_embedding_whitening", "op12_hard_negatives", "op13_line_dedup"]


@pytest.mark.parametrize("name", NAMES)
def test_tasks_load_elsewhere(spark, monkeypatch, tmp_path, name):
    sent = []
    frame = type(spark.range(0))
    map_, broadcast = frame.mapInArrow, type(spark.sparkContext).broadcast

    def mapped(self, work, *args, **kwargs):
        sent.append(cloudpickle.dumps(work))
        return map_(self, work, *args, **kwargs)

    def broadcasted(self, value):
        sent.append(pickle.dumps(value))
        return broadcast(self, value)

    monkeypatch.setattr(frame, "mapInArrow", mapped)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcasted)
    queries.QUERIES[name](spark, SF)
    assert sent
    for i, data in enumerate(sent):
        (tmp_path / str(i)).write_bytes(data)
    load = "\n".join(
        [
            "import pickle, sys",
            "from pyspark.core import broadcast",
            "sys.modules['lexivane'] = None",
            "broadcast._from_id = lambda number: None",
            "for path in sys.argv[1:]: pickle.load(open(path, 'rb'))",
        ]
    )
    files = [str(tmp_path / str(i)) for i in range(len(sent))]
    done = subprocess.run([sys.executable, "-c", load, *files], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
