"""Workers that have no copy of the package: every corpus query runs from another folder, without PYTHONPATH."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

JOB = '''
import importlib.util, sys, tempfile
root, sf, scratch = sys.argv[1:4]
sys.path.insert(0, root)
from coursecast.session import session
import __spark_entry__ as entry
spark = session("workers", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=scratch)

def missing(batches):
    import importlib.util
    found = importlib.util.find_spec("coursecast") is not None
    for batch in batches:
        yield batch if found else batch.slice(0, 0)

assert spark.range(3).mapInArrow(missing, "id long").count() == 0, "the workers have the package"
for name in sorted(entry.LLM):
    n = entry.LLM[name](spark, sf).count()
    print(name, n, flush=True)
    assert n > 0, name
'''


def test_workers_without_the_package(sf, tmp_path):
    root = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    job = tmp_path / "job.py"
    job.write_text(JOB)
    done = subprocess.run(
        [sys.executable, str(job), str(root), sf, str(tmp_path / "scratch")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500,
    )
    assert done.returncode == 0, done.stdout[-2000:] + done.stderr[-4000:]
    assert len(done.stdout.split("\n")) > 13
