"""The rest of the library without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_package(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "landrecon", tmp_path / "landrecon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)},
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, *flags = done.stdout.split()
    assert int(count) > 100 and flags == ["False", "False", "True"]
