"""The library without its text subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "foliospark").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry_has_sql_for_known_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
