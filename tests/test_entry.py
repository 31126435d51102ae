import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "user_id", "lag_1", "mean_5", "std_5", "zscore_5", "flag_5"] and df.count() == 1000


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    ignored = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignored)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'lag_family' in names and not [n for n in names if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; assert set(e.oracle_sql()) <= names"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
