"""The entry module with and without the document operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'flagship' in q; print(len(q), 'pipeline' in q)"


def run(folder) -> str:
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True).stdout


def test_with_and_without_documents(tmp_path):
    shutil.copytree(ROOT / "claimloom", tmp_path / "claimloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert run(tmp_path).split()[1] == "False"
    if (ROOT / "claimloom" / "llm" / "registry.py").exists():
        assert run(ROOT).split()[1] == "True"
