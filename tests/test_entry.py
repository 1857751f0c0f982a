"""The contract module without the text operators: it imports, and the other queries stay."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2:3].isdigit() for k in q))"


@pytest.mark.parametrize("gone", [("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",), ("corpus_pipeline.py",)])
def test_imports_without(tmp_path, gone):
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n, pipeline, ops = out.stdout.split()
    assert int(n) > 70 and pipeline == "False"
    assert ops == str("tidemark/llm" not in gone and (ROOT / "tidemark" / "llm").is_dir())
