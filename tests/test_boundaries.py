"""The training-data package can be taken out, and nothing else imports it."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_llm():
    for p in (ROOT / "sluice").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(import|from)\s.*\bllm\b|corpus_pipeline", p.read_text()), p


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "sluice", tmp_path / "sluice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, has = out.stdout.split()
    assert int(n) > 40 and int(sql) > 35 and has == "False"
