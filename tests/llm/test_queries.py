import os

import pytest

from skillmill.llm import registry
from tests.oracle import FOLDER, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL.get(name))


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p6_ids", "p8_found"])
def test_no_texts_are_shuffled(spark, name):
    """Beside the spreading of small scans."""
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Cartesian" not in plan


def test_nothing_else_imports_this(tmp_path):
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in (root / "skillmill").rglob("*.py"):
        if "llm" not in p.relative_to(root / "skillmill").parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*\bllm\b", p.read_text(), re.M), p
