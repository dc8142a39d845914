"""The driver's contract: names, twins, and that the core never needs the training-data subpackage."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_twins():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and all(callable(f) for f in q.values())


def test_core_does_not_import_the_subpackage():
    for p in (ROOT / "sampleloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "sampleloom").parts:
            assert not re.search(r"sampleloom\.llm|from \.*llm", p.read_text()), p
    code = "import sys; sys.modules['sampleloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p2_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
