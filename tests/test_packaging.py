"""A job started in another folder, with nothing of this library on the workers' path."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {HERE!r})
import __spark_entry__ as entry
from popstat.session import local_session
spark = local_session("elsewhere", 2, "2g")
rows = entry.queries()["poisson_counts"](spark, "/root/testdata/sf0.001").count()
print("ROWS", rows)
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in run.stdout and int(run.stdout.split("ROWS ")[1].split()[0]) > 0, run.stderr[-2000:]
