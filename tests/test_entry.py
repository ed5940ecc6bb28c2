"""The entry works without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import importlib.abc, re, sys

class Refuse(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {refused!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Refuse())
import __spark_entry__ as contract
found = contract.queries()
print(len(found), len([n for n in found if re.match("op[0-9]", n)]), "pipeline" in found)
"""


def run(refused):
    done = subprocess.run([sys.executable, "-c", CODE.format(refused=refused)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return done.stdout.split(), done.stderr


def test_missing_packages_take_nothing_else_along():
    for refused in (["xxhash"], ["tablewright.llm", "corpus_pipeline"]):
        (total, ops, pipeline), said = run(refused)
        assert int(total) > 120 and ops == "0" and pipeline == "False" and "left out" in said
