"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_subpackage(tmp_path):
    for name in ("mosaiq", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "mosaiq/llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin:" + str(Path(sys.executable).parent), "PYTHONPATH": str(tmp_path)}, check=True)
    n, rest = out.stdout.strip().split(" ", 1)
    assert int(n) > 150 and rest == "[]"
