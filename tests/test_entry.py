from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stands_without_the_training_data_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "gridloom"), tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 100


def test_stands_without_a_library_of_the_training_data_queries(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 100


def test_nothing_else_imports_the_training_data_folder():
    for at, folders, names in os.walk(os.path.join(ROOT, "gridloom")):
        if at == os.path.join(ROOT, "gridloom"):
            folders.remove("llm") if "llm" in folders else None
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(at, name)) as f:
                    assert "gridloom.llm" not in f.read(), name


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        found = __spark_entry__.entry(spark)
        assert found.columns[:2] == ["t", "feature_index"] and found.count() > 0
