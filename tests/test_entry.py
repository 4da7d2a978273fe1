import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "detect_by_category" in names


def test_works_without_the_optional_parts(tmp_path):
    for x in ("__spark_entry__.py", "inkveil"):
        source = os.path.join(ROOT, x)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / x)
    shutil.rmtree(tmp_path / "inkveil" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0 and int(done.stdout) > 20, done.stderr


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "inkveil")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert ".llm" not in source.read()
