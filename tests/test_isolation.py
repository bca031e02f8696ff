"""The library works where the training-data operators are taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_llm_folder(tmp_path):
    for name in ("tidyspark", "__spark_entry__.py", "corpus_pipeline.py"):
        at = ROOT / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif at.exists():
            shutil.copy(at, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q1_pricing' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), sorted(q); assert set(e.oracle_sql()) <= set(q)"
    done = _run(tmp_path, code)
    assert done.returncode == 0, done.stderr
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    done = _run(tmp_path, code)
    assert done.returncode == 0, done.stderr
