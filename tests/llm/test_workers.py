"""All operators where only the driver has the package on its path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from echoframe.session import build_session
spark = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
for name, q in e.queries().items():
    if name.startswith("op") and name[2].isdigit():
        assert q(spark, "/root/testdata/sf0.001").count() >= 0
        print("RAN", name)
"""


def test_queries_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if "PYTHONPATH" in os.environ:
        env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ["PYTHONPATH"].split(os.pathsep) if os.path.abspath(p) != REPO)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.count("RAN") == 13
