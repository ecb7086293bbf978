import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[: {depth}] == {parts!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
from vitrine.plans import registry
names = set(entry.queries())
assert names == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
assert len(names) > 150
"""


@pytest.mark.parametrize("missing", ["vitrine.llm"])
def test_imports_without_the_training_data_package(missing):
    parts = missing.split(".")
    code = HIDDEN.format(depth=len(parts), parts=parts)
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_errors_inside_an_installed_module_are_not_hidden():
    code = HIDDEN.split("import __spark_entry__")[0].format(depth=1, parts=["sentinel_of_the_test"])
    code += """
import importlib
import __spark_entry__ as entry
import types
real = importlib.import_module
def broken(name):
    raise ModuleNotFoundError("No module named 'other'", name="other")
importlib.import_module = broken
try:
    entry._if_present("vitrine.llm.queries")
except ModuleNotFoundError:
    sys.exit(0)
sys.exit(1)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
