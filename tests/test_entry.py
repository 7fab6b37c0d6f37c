"""The entry module without its optional parts."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    return out.stdout.split("NAMES")[1].split()


def test_without_the_optional_parts(tmp_path):
    """Folders of links that leave out the training-data operators, the pipeline, or both."""
    left_out = {"both": {"llm", "corpus_pipeline.py"}, "llm": {"llm"}, "pipeline": {"corpus_pipeline.py"}}
    found = {}
    for case, gone in left_out.items():
        here = tmp_path / case
        (here / "echoframe").mkdir(parents=True)
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if name not in gone and os.path.exists(f"{REPO}/{name}"):
                # A copy: the module finds its package beside itself.
                (here / name).write_text(open(f"{REPO}/{name}").read())
        for name in os.listdir(f"{REPO}/echoframe"):
            if name not in gone:
                (here / "echoframe" / name).symlink_to(f"{REPO}/echoframe/{name}")
        found[case] = names(here)
    assert found["both"] == found["llm"] and "ols_coefs" in found["both"]
    assert not [n for n in found["both"] if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
    assert "pipeline" not in found["pipeline"]
