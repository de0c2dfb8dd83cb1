import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e, bench; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), set(e.oracle_sql()) <= set(q))"


def test_entry_imports_when_the_training_operators_are_deleted(tmp_path):
    kept = shutil.ignore_patterns(".git", "llm", "__pycache__", "*_r[0-9]*")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=kept)
    assert (copy / "corpus_pipeline.py").exists() or not (ROOT / "corpus_pipeline.py").exists()
    for gone in ([], [copy / "corpus_pipeline.py"]):
        for file in gone:
            file.unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert done.stdout.split()[1:] == ["False", "False", "True"]
