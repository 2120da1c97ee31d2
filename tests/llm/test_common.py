from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa

from ebbline.llm.common import BATCH_ROWS, map_batches, stage

REPO = Path(__file__).resolve().parents[2]
ELSEWHERE = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from ebbline.session import get_session, ship_package
spark = get_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__checkpoint__dir=sys.argv[1], spark__sql__shuffle__partitions="2")
ship_package(spark)
from pyspark.sql import functions as F
from ebbline.llm.topk import top_k
from ebbline.llm.token_counts import count_tokens
vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
assert top_k(vectors, F.col("vec_id") % 50 == 0).count() == 10
assert count_tokens(spark.createDataFrame([(1, "some words")], "doc_id long, text string")).first()["n_words"] == 2
"""


def test_batches_are_sliced_and_the_session_stays_as_it_is(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    mapped = map_batches(spark.range(0, 2500, 1, 1), sizes, "n long")
    for rows in (mapped, stage(mapped, "sizes")):
        found = [r["n"] for r in rows.collect()]
        assert sum(found) == 2500 and max(found) <= BATCH_ROWS and spark.conf.get(key) == before


def test_workers_need_not_have_the_package(tmp_path):
    """A session started in another folder, whose workers only get what is sent to them."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ELSEWHERE, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert run.returncode == 0, "\n".join(x for x in run.stderr.splitlines() if "Error" in x)[-2000:]
