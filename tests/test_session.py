"""Scratch tables of a session."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popstat.session import SMALL_BATCH, cut_lineage, delete_scratch, scratch_path, scratch_paths, small_batches, temporary_tables

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import os, sys
sys.path.insert(0, {HERE!r})
from popstat.session import cut_lineage, delete_scratch, local_session, shared_folder
spark = local_session("scratch", 1, "1g")
assert cut_lineage(spark.range(5)).count() == 5
folder = shared_folder(spark)
before = len(os.listdir(folder.removeprefix("file://")))
print("LEFT", before, delete_scratch(spark), delete_scratch(spark), len(os.listdir(folder.removeprefix("file://"))))
"""


def test_scratch_is_deleted_on_request():
    run = subprocess.run([sys.executable, "-c", JOB], capture_output=True, text=True, timeout=300)
    before, deleted, again, after = map(int, run.stdout.split("LEFT ")[1].split()[:4])
    assert deleted == 1 and again == 0 and after == before - 1, run.stderr[-1500:]


def test_scratch_paths_are_new(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    df = cut_lineage(spark.createDataFrame([(1, None)], "a int, b string"))
    assert df.columns == ["a", "b"] and df.count() == 1


def test_temporary_tables_go_and_what_outlives_them_stays(spark):
    before = scratch_paths(spark)
    with temporary_tables(spark):
        inner = cut_lineage(spark.range(10))
        with temporary_tables(spark):
            cut_lineage(inner.where("id > 7"))
            kept = cut_lineage(inner.where("id > 5"), outlive=True)
        result = cut_lineage(kept.where("id > 6"), outlive=True)
        assert len(scratch_paths(spark)) == len(before) + 3
    assert result.count() == 3 and len(scratch_paths(spark)) == len(before) + 1
    (made,) = set(scratch_paths(spark)) - set(before)
    assert delete_scratch(spark, [made]) == 1 and scratch_paths(spark) == before


def test_temporary_tables_go_after_an_error(spark):
    before = scratch_paths(spark)
    with pytest.raises(ValueError), temporary_tables(spark):
        cut_lineage(spark.range(3))
        raise ValueError
    assert scratch_paths(spark) == before


def test_small_batches_hold_few_rows_and_bytes_only_inside(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    def largest(text):
        texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), text))
        return tuple(texts.mapInArrow(sizes, "n long, size long").agg(F.max("n"), F.max("size")).first())

    before = {name: spark.conf.get(name) for name in SMALL_BATCH}
    assert largest(10)[0] == 3000
    with small_batches(spark):
        assert largest(10)[0] == 1000 and largest(10_000)[1] < 5 << 20
    assert {name: spark.conf.get(name) for name in SMALL_BATCH} == before
