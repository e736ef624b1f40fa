"""Components in few shuffles, components after more links, features that meet an id once, and no shuffle files left."""

import random
import time
from pathlib import Path

from fixtures import Union
from pyspark.sql import functions as F

from riskmill.llm import common
from riskmill.session import CLEANUP_CONF


def test_a_round_of_components_shuffles_three_times(spark, monkeypatch):
    plans, checkpoint = [], common.reliable_checkpoint

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    monkeypatch.setattr(common, "reliable_checkpoint", kept)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint")
    found = {r.id: r.component for r in common.components(edges).collect()}
    assert found == {i: 0 for i in range(51)}
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") <= 3 for p in plans)


def test_components_after_more_links_equal_those_of_all_links(spark):
    rng = random.Random(8)
    for n, m in ((60, 40), (60, 0), (0, 40)):
        first = [(rng.randrange(90), rng.randrange(90)) for _ in range(n)]
        more = [(rng.randrange(90), rng.randrange(90)) for _ in range(m)]
        found = common.components(spark.createDataFrame(first, "a bigint, b bigint"))
        got = common.merged(found, spark.createDataFrame(more, "a bigint, b bigint")).collect()
        union = Union()
        for a, b in first + more:
            if a != b:
                union.join(a, b)
        assert sorted((r.id, r.component) for r in got) == sorted((i, union.find(i)) for i in union.up)


def test_an_id_of_many_buckets_meets_its_features_once(spark):
    placed = spark.range(300).select((F.col("id") % 30).alias("bucket"), F.floor(F.col("id") / 30).alias("id"), F.lit(7).alias("part"))
    known = spark.createDataFrame([(i, 10 * i) for i in range(10)], "id bigint, n bigint")
    out = common._described(placed, known)
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Generate") < joined.index("Join")  # the buckets are opened above the join
    assert sorted((r.bucket, r.id, r.n) for r in out.collect()) == [(b, i, 10 * i) for b in range(30) for i in range(10)]


def test_linking_and_stored_frames_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for folder in folders for f in Path(folder).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(CLEANUP_CONF, None)
    buckets = spark.createDataFrame([(b, i) for b in (5, 9) for i in range(40)], "bucket bigint, id bigint")
    prepare = lambda ids: (lambda pairs: pairs.where("abs(a - b) = 1"), lambda some: some, F.lit(True))
    found = common.linked(buckets, prepare, "chain")
    assert common.stored(buckets.groupBy("bucket").count(), "counts").count() == 2
    for _ in range(50):  # files go in the background
        left = files() - before
        if len(left) <= 8:
            break
        time.sleep(0.1)
    assert len(left) <= 8, len(left)
    assert {(r.id, r.component) for r in found.collect()} == {(i, 0) for i in range(40)}
    assert spark.conf.get(CLEANUP_CONF, None) == setting
