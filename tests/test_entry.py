"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(tmp_path):
    """What is left after both folders and the pipeline are gone still imports."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_entry_shows_other_missing_modules(tmp_path):
    """Only the subpackage and the pipeline may be missing."""
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert found.returncode and "no_such_module_anywhere" in found.stderr
    (tmp_path / "corpus_pipeline.py").write_text("from folioscope.llm import simhash\n")
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'pipeline' not in e.queries()"], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
