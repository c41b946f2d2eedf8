"""A hierarchy that grows by joins also settles where no shared folder is set."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
from lodeweave.operators import taxonomy
from lodeweave.session import local_session
spark = local_session("plain", "2", 2)
edges = spark.createDataFrame([(f"t{k}", f"t{k + 1}", "contains") for k in range(40)] + [("t40", "t0", "contains")], "parent string, child string, relation string")
roots = spark.createDataFrame([("t0",), ("t39",)], "root string")
deep = {(r.root, r.tag) for r in taxonomy.closure(edges, roots, small=0).collect()}
assert deep == {(r.root, r.tag) for r in taxonomy.closure(edges, roots).collect()} and len(deep) == 82
"""


def test_deep_closure_without_a_shared_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
