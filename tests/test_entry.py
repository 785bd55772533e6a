"""The driver's contract, and independence of the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20


def test_imports_without_the_training_data_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("latticework.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(q.startswith("op") or q == "pipeline" for q in e.queries()), e.queries().keys()
assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "latticework").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path
