"""The package reaches Python workers that start in another folder."""

import os
import subprocess
import sys

from .conftest import SF001

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from tablescope.session import get_session
spark = get_session(2)
print("rows", entry.queries()["correlations"](spark, {sf!r}).count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TABLESCOPE_DRIVER_MEMORY": "1g"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=SF001)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 64" in done.stdout, done.stderr[-2000:]
