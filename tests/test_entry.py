import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_what_the_training_data_operators_need_may_be_missing(tmp_path):
    """A folder left empty, and a library that isn't there: the other queries stay."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})
    for f in (tmp_path / "r/palimpsest/llm").glob("*.py"):
        f.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_import_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True)


def test_shared_folder_without_a_scheme(tmp_path):
    """It lies in the default file system, not on the local disk of whoever opens it; and a run's folder goes when it ends."""
    (tmp_path / "store").mkdir()
    code = f"""
from pyspark.sql import SparkSession
from palimpsest import session
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.hadoop.fs.defaultFS", "viewfs://m/")
    .config("spark.hadoop.fs.viewfs.mounttable.m.link./ck", "file://{tmp_path}/store").config("spark.checkpoint.dir", "/ck").getOrCreate())
assert session.shared_root(spark).startswith("file:") and session.shared_root(spark).endswith("{tmp_path}/store")
with session.run_folder(spark) as folder:
    path = session.scratch(spark, "x")
    assert path.startswith(folder) and session.stored(spark.range(3), "y").count() == 3
import os
assert not [x for x in os.listdir("{tmp_path}/store") if x.startswith("run-")]
assert session.shared_root(spark).endswith("{tmp_path}/store")
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
