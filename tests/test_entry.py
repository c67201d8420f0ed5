import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
