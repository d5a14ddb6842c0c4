import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_imports_without_the_optional_folders(tmp_path):
    import shutil

    shutil.copytree(REPO / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_phrase' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
