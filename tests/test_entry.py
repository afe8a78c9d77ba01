"""The entry file with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"


def names(folder):
    found = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return set(found.stdout.split())


def test_without_text_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "ostinato", tmp_path / "ostinato", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    core = names(tmp_path)
    assert "cell_summary" in core and "pipeline" not in core
    if (ROOT / "ostinato" / "llm").exists():
        more = names(ROOT) - core
        assert "pipeline" in more and {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in more if x.startswith("op")}


def test_real_faults_are_shown(tmp_path):
    """A missing module inside the text operators is no reason to go on without them."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "ostinato", tmp_path / "ostinato", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "ostinato" / "llm").mkdir()
    (tmp_path / "ostinato" / "llm" / "__init__.py").touch()
    (tmp_path / "ostinato" / "llm" / "queries.py").write_text("import no_such_module\n")
    found = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode and "no_such_module" in found.stderr
