"""The entry module imports without a session and names queries and SQL alike."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 140"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_only_the_entry_module_knows_the_optional_part():
    for path in (ROOT / "loomline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_entry_gives_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 6 and {"system", "metric", "mean", "low", "high"} == set(rows[0].asDict())
