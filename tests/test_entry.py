"""The entry module with and without its optional part, and the package's public names."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)


@pytest.fixture
def bare(tmp_path):
    shutil.copytree(os.path.join(TOP, "cellweave"), tmp_path / "cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_the_rest_works_without_the_optional_part(bare):
    done = run(bare, "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n == 'pipeline' or n[:2] == 'op' and n[2].isdigit() for n in q), sorted(q)")
    assert done.returncode == 0, done.stderr


def test_a_pipeline_without_its_part_is_left_out(bare):
    (bare / "corpus_pipeline.py").write_text("from cellweave.llm.common import written\n")
    done = run(bare, "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'pipeline' not in e.oracle_sql()")
    assert done.returncode == 0, done.stderr


def test_a_broken_import_is_an_error(bare):
    os.mkdir(bare / "cellweave" / "llm")
    (bare / "cellweave" / "llm" / "__init__.py").write_text("")
    (bare / "cellweave" / "llm" / "queries.py").write_text("import a_library_that_is_missing\n")
    done = run(bare, "import __spark_entry__ as e; e.queries()")
    assert done.returncode and "a_library_that_is_missing" in done.stderr


def test_public_names():
    import cellweave

    assert all(callable(getattr(cellweave, n)) for n in cellweave.__all__)
    with pytest.raises(AttributeError):
        cellweave.nothing  # noqa: B018
