"""The driver's contract, with the text operators and without them."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(x.startswith('op') for x in q), 'pipeline' in q)"


def said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(folder)}).stdout.split()


def test_all_is_registered_without_a_session():
    total, own, pipeline = said(TOP)
    assert int(total) > 130 and (not os.path.isdir(f"{TOP}/keyloom/llm") or (own, pipeline) == ("10", "True"))


def test_the_rest_works_alone(tmp_path):
    shutil.copytree(f"{TOP}/keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{TOP}/__spark_entry__.py", tmp_path)
    total, own, pipeline = said(tmp_path)
    assert int(total) > 130 and own == "0" and pipeline == "False"
