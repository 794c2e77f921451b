"""The driver reads the entry points without a Spark session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_points_need_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); import corpus_pipeline" if os.path.isdir(f"{ROOT}/plugscope/llm") else "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
