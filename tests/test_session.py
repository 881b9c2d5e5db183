"""Shared folder, shipping of the package, and hostile rows."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tollgate import session
from tollgate.functions.canonical import canonical_json
from tollgate.operators.code import code_problem

ROOT = Path(__file__).resolve().parents[1]


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
    assert session.on_one_machine(spark)


def test_queries_run_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as entry\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', entry.queries()['code_audit'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_hostile_rows_do_not_end_the_job(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = spark.createDataFrame([(1, deep), (2, '{"b": 1, "a": 2}')], "id int, body string")
    got = {r["id"]: r["c"] for r in rows.select("id", canonical_json(F.col("body")).alias("c")).collect()}
    assert got == {1: None, 2: '{"a": 2, "b": 1}'}
    codes = spark.createDataFrame([(1, "-" * 100_000 + "1"), (2, "print(1)"), (3, "x" + ".a" * 50_000)], "id int, code string")
    problems = {r["id"]: r["p"] for r in codes.select("id", code_problem(F.col("code")).alias("p")).collect()}
    assert problems[2] is None and problems[1] and (problems[3] is None or "Syntax" in problems[3])


def test_the_rest_stands_without_the_training_data(tmp_path):
    """The entry point and the other queries import when the subpackage and the pipeline are gone."""
    script = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tollgate.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as entry\n"
        "names = entry.queries()\n"
        "assert len(names) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
    )
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=120)
