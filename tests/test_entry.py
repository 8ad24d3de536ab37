"""The driver's entry points, with and without the training-data package."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0 and "sum_price" in df.columns


def test_names_are_unique_and_have_sql():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "pricing_summary" in entry.oracle_sql()


def test_works_without_the_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "relq"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (ROOT / "relq").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "relq" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_a_broken_import_is_not_hidden(tmp_path):
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    (tmp_path / "relq" / "llm").mkdir(parents=True)
    for p in (ROOT / "relq").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "relq" / p.name).symlink_to(p)
    (tmp_path / "relq" / "llm" / "__init__.py").touch()
    (tmp_path / "relq" / "llm" / "queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert "no_such_module" in done.stderr
