"""Scratch tables: what is left of them."""

import os

from tallyspark.sources.scratch import only_last_kept, scratch_path, stored


def test_only_the_last_table_stays(spark):
    before = stored(spark.range(3), "kept-before")
    with only_last_kept(spark):
        inner = stored(spark.range(5), "between")
        last = stored(inner.filter("id > 1"), "result")
    assert last.count() == 3 and before.count() == 3
    gone = inner.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(gone)
    assert os.path.dirname(scratch_path(spark, "next")) == os.path.dirname(scratch_path(spark, "next"))
