"""The entry without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len(e.queries()), sorted(k for k in e.queries() if k.startswith("op") or k == "pipeline"))
"""


@pytest.mark.parametrize("module", ["public_tokenizers", "zstandard", "studbook.llm", "corpus_pipeline"])
def test_registry_queries_stay_without_an_optional_module(module):
    run = subprocess.run([sys.executable, "-c", PROBE, module], cwd=ROOT, capture_output=True, text=True, check=True)
    count, rest = run.stdout.split(" ", 1)
    assert int(count) >= 169 and rest.strip() == "[]" and "left out" in run.stderr


def test_a_missing_part_of_the_registry_is_an_error():
    run = subprocess.run([sys.executable, "-c", PROBE, "studbook.operators.matching"], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode != 0
