"""A plain local session, as from a bare checkout: no preset checkpoint folder, no Spark defaults."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from specsheet.session import ensure_checkpoint_dir, get_spark, materialize
spark = get_spark("local[2]")
assert spark.conf.get("spark.checkpoint.dir", None) is None, "preset"
path = ensure_checkpoint_dir(spark)
assert path == ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
assert materialize(spark.range(5)).count() == 5
import __spark_entry__
assert __spark_entry__.entry(spark).count() > 0
print("started")
"""


def test_starts_without_preset_checkpoint_dir(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    run = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "started" in run.stdout, run.stderr[-2000:]


def test_queries_import_without_a_tokenizer_library(tmp_path):
    """A library that only the corpus operators need may be absent: the other queries are there."""
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('none here', name='public_tokenizers')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'by_brand' in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, cwd=ROOT,
                         capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout) > 100, run.stderr[-2000:]
