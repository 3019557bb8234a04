"""What Python workers hold while queries read strict CSV."""

import tracemalloc

import pytest
from pyspark import AccumulatorParam

import __spark_entry__


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


@pytest.mark.parametrize("name", ["legacy_redirected_load", "legacy_frame", "legacy_frame_without_nested"])
def test_workers_hold_no_file(spark, monkeypatch, name):
    most, kind = spark.sparkContext.accumulator(0, Most()), type(spark.range(1))
    plain = kind.mapInArrow

    def traced(df, func, *args, **kwargs):
        def run(batches):
            tracemalloc.start()
            try:
                for batch in func(batches):
                    yield batch
            finally:
                most.add(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()

        return plain(df, run, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", traced)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.1").count() == 150_000
    assert 0 < most.value < 15e6, most.value
