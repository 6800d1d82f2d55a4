"""Every operator and stage on odd rows, on empty tables, and with clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import decontaminate, html_extract, license_scan, line_dedup, packing, quality, sharding, simhash, toxicity, wavelet

SF = "/root/testdata/sf0.01"


def bench(spark):
    return spark.createDataFrame([(1, "the very same line of text that several rows have"), (1, "the very same line of text that several rows have"), (2, None), (3, ""), (None, "another text under an id that is used already")], "item_id long, text string").withColumn("doc_id", F.lit("x"))


def model():
    m = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, 0.0)
    return m


OPS = {
    "contaminated": lambda s, d: decontaminate.contaminated(d, bench(s)),
    "without_contaminated": lambda s, d: decontaminate.without_contaminated(d, bench(s)),
    "licenses": lambda s, d: license_scan.scanned(d),
    "wavelet": lambda s, d: wavelet.wavelet_shards(d),
    "quality": lambda s, d: quality.cleaned(d),
    "toxic": lambda s, d: toxicity.toxic_documents(d, model()),
    "sharded": lambda s, d: sharded(d),
    "near": lambda s, d: simhash.near_duplicates(d),
    "packed": lambda s, d: packing.packed(d),
    "lines": lambda s, d: line_dedup.deduplicated(d),
    "lines_stage": lambda s, d: line_dedup.cleaned(d),
    "html": lambda s, d: html_extract.extracted(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit(1).alias("n_blocks"))),
}


def sharded(d):
    return sharding.sharded(d, shards=4, bucket_groups=3)


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty(spark, none, name):
    assert OPS[name](spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_rows(spark, odd, name):
    OPS[name](spark, odd).collect()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, odd, none, name, stage):
    kept = stage(spark, odd, SF)
    assert kept.columns == odd.columns and kept.schema.simpleString() == odd.schema.simpleString()
    assert kept.count() <= odd.count()
    assert stage(spark, none, SF).count() == 0


def test_null_and_empty_results(spark, odd):
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in OPS["contaminated"](spark, odd).collect()) == [(0, 1), (4, 1), (4, 1), (5, 0), (5, 1)]
    near = {(r.doc_id, r.keep_id) for r in OPS["near"](spark, odd).collect()}
    assert near == {(5, 4)}
    lines = {(r.doc_id, r.text) for r in OPS["lines"](spark, odd).collect()}
    assert (1, None) in lines and (2, "") in lines and (5, "") in lines and (None, None) in lines
    kept = {r.doc_id for r in OPS["lines_stage"](spark, odd).collect()}
    assert {1, 2, 3, 4, None} <= kept
    assert {r.doc_id for r in OPS["quality"](spark, odd).collect()} >= {None, 4, 5, 6}
    pieces = OPS["packed"](spark, odd).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {None, 3, 4, 5, 6, 7, 8, 9, 10}
    shards = OPS["sharded"](spark, odd)
    assert shards.count() == odd.count() and shards.groupBy("group").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    html = {r.page_id: r for r in OPS["html"](spark, odd).collect()}
    assert html[1].text == "" and html[1].n_blocks == 0


def test_no_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxic_documents(odd, toxicity.trained(odd, labels)).count() == 0
    one = spark.createDataFrame([(4, 1, 1), (None, 1, 1), (99, 0, None), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxic_documents(odd, toxicity.trained(odd, one)).count() == 0
