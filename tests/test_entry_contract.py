"""Driver contract: names, twins and a stable flagship schema."""

import re

import __spark_entry__ as E


def test_query_names_are_plain_and_twins_exist():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) >= 100 and set(s) <= set(q)
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)


def test_entry_imports_without_the_optional_folder(tmp_path):
    """The entry module must work where the training-data folder and pipeline are absent."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "cohort"), tmp_path / "cohort",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 100 and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry_schema_is_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema and a.count() == b.count() > 0
