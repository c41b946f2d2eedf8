"""Operators that cut tables also run where no shared folder is set."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
from lodeweave.llm import common, copies, simhash
from lodeweave.session import local_session
spark = local_session("plain", "2", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")], "doc_id long, text string")
assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [1, 1, 3]
assert sorted(r.doc_id for r in copies.keep_one(docs).collect()) == [1, 3]
print(common.shared_dir(spark))
"""


def test_without_a_shared_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    left = Path(done.stdout.split()[-1].removeprefix("file://"))
    assert not any(left.iterdir())  # what was cut is deleted when the driver ends
