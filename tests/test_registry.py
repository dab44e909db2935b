import subprocess
import sys
from pathlib import Path


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_flagship(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row.n > 0 and 0 < row.top1 <= row.top5 <= 1
