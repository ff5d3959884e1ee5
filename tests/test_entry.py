"""The driver's contract, and independence of the core from the optional subpackage."""

import importlib
import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())
    assert {"p7_found", "p7_report"} <= set(q)


def test_core_does_not_import_the_optional_part():
    for f in (ROOT / "quarrystone").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", f.read_text(), re.M), f
    importlib.import_module("quarrystone.plans.catalog")
