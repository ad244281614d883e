import importlib.util
import subprocess
import sys

import pytest

from conftest import ROOT, SMALL
from lectern.plans import registry

#: Empty on the smallest tables, where no row breaks the rule.
MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(name, agrees):
    n = agrees(registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert n > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_optional_parts(tmp_path):
    """A copy without the llm folder and the pipeline still has all other queries."""
    import os
    import shutil

    for name in ("lectern", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))], said.stderr
    assert importlib.util.find_spec("lectern") and SMALL
