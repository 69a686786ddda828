import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_queries_and_twins_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_optional_folders(tmp_path):
    """A copy of the repository without them imports and still has its queries."""
    root = Path(entry.__file__).parent
    (tmp_path / "scriptorium").mkdir()
    for p in (root / "scriptorium").iterdir():
        if p.name != "llm":
            (tmp_path / "scriptorium" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    n, op = out.stdout.split()
    assert int(n) > 40 and op == "False", out.stderr
