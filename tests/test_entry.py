"""The driver's contract, with and without the llm subpackage."""

import importlib.util
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root: str) -> list[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}).stdout.split()


def test_queries_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    rest = names(str(tmp_path / "r"))
    assert {"p1_found", "p2_found", "p3_found"} <= set(rest) and not any(n.startswith(("p4_", "p5_", "p6_", "p7_", "p8_")) for n in rest)
    if importlib.util.find_spec("recollect.llm") is not None:
        assert {"p4_found", "p5_found", "p6_ids", "p7_found", "p8_found"} <= set(names(ROOT))


def test_nothing_outside_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "recollect")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert "recollect.llm" not in text, f
