"""The driver's contract: names, SQL, and that modules import without a session and without the text operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_sql_is_of_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100; from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_imports_without_text_operators(tmp_path):
    for p in ("__spark_entry__.py", "terralith"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "terralith/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ortho_nearest' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
