"""What stage tables leave on disk."""

import os
import tempfile
import time
from pathlib import Path

from topicflow.session import discard, materialize, materialize_parts


def shuffles(spark):
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    return {str(p) for d in local.split(",") for p in Path(d).glob("blockmgr-*/*/shuffle_*.data")}


def test_the_shuffles_of_a_stage_table_go_with_its_write(spark):
    before = shuffles(spark)
    rows = spark.range(1000).repartition(4, "id")
    stage = materialize(rows, name="rows")
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert stage.count() == rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_parts_are_one_table_and_can_be_discarded(spark):
    parts = [spark.range(i, i + 3).selectExpr("id", "id % 2 AS even") for i in (0, 3)]
    stage = materialize_parts(parts, "even", name="parts")
    assert sorted(map(tuple, stage.collect())) == [(i, i % 2) for i in range(6)] and stage.columns == ["id", "even"]
    other = materialize(stage, name="other")
    files = [f.removeprefix("file://") for f in stage.inputFiles()]
    discard(stage)
    assert not any(map(os.path.exists, files)) and other.count() == 6
