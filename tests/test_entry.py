"""The entry point works without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(f"{REPO}/__spark_entry__.py", copy)
    shutil.copytree(f"{REPO}/fleetlens", copy / "fleetlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n[:2] == 'op' and n[2].isdigit() for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found, sql, has_op = done.stdout.split()
    assert int(found) > 140 and int(sql) > 130 and has_op == "False"
