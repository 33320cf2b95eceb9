import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "foliograph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "foliograph").parts:
            assert "foliograph.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "foliograph", tmp_path / "foliograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
