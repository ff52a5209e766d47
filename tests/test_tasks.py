import gc

import pytest
from pyspark.sql import functions as F

from vellum.functions import kernels as K
from vellum.functions import tasks
from vellum.operators import anchors as A
from vellum.operators import markdown as M
from vellum.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_larger_inputs_are_dealt_to_more_tasks(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["anchors_through_edits"](spark, SMALL).collect()))
    monkeypatch.setattr(tasks, "TASK_BYTES", 2 << 10)
    dealt = QUERIES["anchors_through_edits"](spark, SMALL)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    assert dealt.rdd.getNumPartitions() > 4  # the session's number of partitions
    assert sorted(map(tuple, dealt.collect())) == whole


def test_inputs_of_unknown_size_are_left_to_spark(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "k int")
    assert tasks.dealt_by_size(rows, ["k"]) is rows


def test_equal_anchors_stay_and_move_once(spark):
    anchors = spark.createDataFrame([("n", 1, 10, 14, "term")] * 2 + [("n", 2, 3, 7, "term"), ("m", 3, 1, 5, "term")], "path string, id int, start int, end int, text string")
    edits = spark.createDataFrame([("n", 0, 2, "four"), ("n", 10, 10, "in"), ("n", 4, 5, None)], "path string, start int, end int, insert string")
    got = A.through_edits(anchors, edits, ["path"]).select("id", "start", "end").orderBy(F.col("id"))
    assert list(map(tuple, got.collect())) == [(1, 14, 18), (1, 14, 18), (3, 1, 5)]


@pytest.mark.parametrize("name", ["protected_spans", "extract_all_sources", "word_phrases_top16", "heading_asof"])
def test_note_kernels_take_small_batches(spark, name):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(conf, str(64 << 20))
    QUERIES[name](spark, SMALL)
    assert int(spark.conf.get(conf)) <= 4 << 20


def test_the_rows_of_one_note_are_held_chunk_by_chunk(spark):
    def kernel(text):
        class Held(tuple):
            pass

        for i in range(int(text)):
            yield Held((i, sum(type(x) is Held for x in gc.get_objects())))

    notes = spark.createDataFrame([("n", "25")], "path string, content string")
    got = K.per_note(notes, ["path"], ["content"], kernel, "i int, held int", chunk=10).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(25)) and max(r["held"] for r in got) <= 10


def test_spans_of_many_batches(spark):
    text = "a `b` c\n" * 2_000
    rows = spark.range(400).select("id", F.lit(text).alias("content"))
    got = M.with_spans(rows).select("id", F.size("spans").alias("n")).collect()
    assert len(got) == 400 and {r["n"] for r in got} == {2_000}
