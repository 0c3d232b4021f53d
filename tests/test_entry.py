import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """A copy without both folders and the corpus pipeline still imports, registers and runs."""
    root = Path(entry.__file__).resolve().parent
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    for name in ("tidemark", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = (
        "import __spark_entry__ as e\n"
        "from tidemark.session import session\n"
        "q = e.queries()\n"
        "assert 'candle_resample_4h' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
        "spark = session('copy', cores=2)\n"
        "assert q['serving_latest'](spark, '/root/testdata/sf0.001').count() == 5\n"
    )
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path), "PYSPARK_PYTHON": sys.executable, "PYSPARK_DRIVER_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_a_broken_import_is_not_hidden(tmp_path):
    """Only the absence of the folders is tolerated."""
    root = Path(entry.__file__).resolve().parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tidemark/llm").mkdir()
    (tmp_path / "tidemark/llm/__init__.py").touch()
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode != 0 and "no_such_module" in run.stderr
