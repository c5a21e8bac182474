import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "stillroom"), tmp_path / "stillroom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "p5_found" in said.stdout and "groups_view" in said.stdout and "p6_found" not in said.stdout, said.stderr


@pytest.mark.parametrize("name", ["groups_view", "match_edges", "normalized_titles", "p7_changes"])
def test_plans_stay_in_the_jvm_without_nested_loops(spark, name):
    import __spark_entry__ as e

    data = "/root/testdata/sf0.001"
    if not os.path.exists(data):
        pytest.skip("no test data here")
    plan = e.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
