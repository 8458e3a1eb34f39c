"""The driver contract must hold whatever optional parts are present."""

import subprocess
import sys

from conftest import ROOT

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
from cartlift.plans.catalog import QUERIES
assert set(e.queries()) == set(QUERIES), sorted(set(e.queries()) ^ set(QUERIES))
assert set(e.oracle_sql()) <= set(QUERIES)
"""


def _without(*names):
    return subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True)


def test_queries_survive_a_missing_package():
    got = _without("public_tokenizers")
    assert got.returncode == 0, got.stderr


def test_queries_survive_without_the_training_data_folder():
    got = _without("cartlift.llm", "corpus_pipeline")
    assert got.returncode == 0, got.stderr
