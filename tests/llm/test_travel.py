"""Queries in workers that do not have the package: everything a task needs travels with it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from webstrata.session import local_session
from webstrata.llm import queries
spark = local_session("2", "travel", **{{"spark.sql.shuffle.partitions": "2"}})
import importlib.util
kinds = spark.sparkContext.parallelize([1], 1).map(lambda _: importlib.util.find_spec("webstrata") is None).collect()
assert kinds == [True], "the workers have the package"
print("ROWS", queries.QUERIES[{name!r}](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", ["op5_parity_join", "op7_main_text", "op9_language_id", "op12_secret_novelty"])
def test_workers_need_no_copy(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, name=name)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in done.stdout, done.stderr[-3000:]
