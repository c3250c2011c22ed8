"""The library stands without its optional subpackage, and imports nothing of it."""

import ast
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "assaykit").rglob("*.py"):
        if "llm" in path.relative_to(REPO / "assaykit").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_without_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('assaykit.llm') or name == 'corpus_pipeline':
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'events_trend' in e.queries() and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_every_sql_has_a_query():
    from assaykit.plans import catalogue

    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 55
