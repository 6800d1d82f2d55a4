"""What each operator gives for odd rows, ties, very long texts and empty tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import decontaminate, html_extract, license_scan, packing, quality, sharding, simhash, toxicity, wavelet
from spindrift.llm.common import remove, settings, stored
from spindrift.llm.license_texts import LICENSES

SF = "/root/testdata/sf0.01"
MIT = next(t for n, t in LICENSES if n == "MIT")


@pytest.fixture(scope="module")
def enc():
    return wavelet.encoding()


@pytest.mark.parametrize("white", [" ", "\n", " \n", "\t ", "　 "])
@pytest.mark.parametrize("tail", ["", "b", " b", "'s", "\x1c", "1"])
def test_ids_around_long_white_space_are_the_tokenizers(enc, white, tail):
    text = "abc, d" + white * 5000 + tail + white * 4097 + "z" + white * 4096
    assert wavelet.token_ids(enc, text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["hello,world;" * 100_000, "two words " * 110_000, "x" * (1 << 21), "a1" * (1 << 19), "." * (1 << 20)])
def test_ids_of_long_texts_are_the_tokenizers(enc, text):
    assert len(text) >= 1 << 20 and wavelet.token_ids(enc, text) == enc.encode_ordinary(text)


def test_white_space_beyond_the_tokenizers_stack(enc):
    assert enc.decode(wavelet.token_ids(enc, "a" + " " * 2_000_000 + "b")) == "a" + " " * 2_000_000 + "b"


def test_shards_of_odd_rows(spark, odd, enc):
    rows = [(r.doc_ids, r.blob) for r in wavelet.wavelet_shards(odd.coalesce(1)).collect()]
    got = [(d, enc.decode(m.decode()[m.offsets[k] : m.offsets[k + 1]].tolist())) for ids, blob in rows for m in [wavelet.WaveletMatrix(blob)] for k, d in enumerate(ids)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=key)


def test_no_shards_no_files(spark, none, tmp_path):
    assert wavelet.write_shards(wavelet.wavelet_shards(none), f"file://{tmp_path}/w").count() == 0


def test_licenses_of_odd_rows(spark, odd):
    assert license_scan.scanned(odd).count() == 0
    rows = [(None, MIT), (1, MIT), (1, MIT), (2, "x " * 200_000 + "\n" + "y"), (3, "intro\n" + " ".join(MIT.split("\n"))), (4, "\n\n" + MIT + "\n")]
    got = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id or 0, r.scope, r.line, r.license) for r in got)
    assert found == [(0, "document", -1, "MIT"), (1, "document", -1, "MIT"), (1, "document", -1, "MIT"), (3, "line", 1, "MIT"), (4, "document", -1, "MIT")]


def test_quality_ties(spark):
    df = spark.createDataFrame([(1, "a b c d e\nAll rights reserved."), (2, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    lost = len("All rights reserved.") / len("a b c d eAll rights reserved.")
    got = quality.cleaned(df, most_lost=round(lost, 6), least_words=5).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2] and {r.text for r in got} == {"a b c d e"}
    assert sorted(r.doc_id for r in quality.cleaned(df, most_lost=round(lost, 6) - 1e-6, least_words=5).collect()) == [2, 2]


def test_contained_at_the_threshold(spark, none):
    words = [f"w{i}" for i in range(14)]  # ten shingles of five words
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:9] + ["x"] + words[10:])), (2, "pad " * 50_000 + " ".join(words) + " pad" * 50_000)], "doc_id long, text string")
    five = decontaminate.contaminated(docs, items, threshold=0.5)
    assert {(r.doc_id, r.containment) for r in five.collect()} == {(1, 0.5), (2, 1.0)}
    assert decontaminate.without_contaminated(docs, items, threshold=0.5).count() == 0
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == 2
    assert decontaminate.without_contaminated(none, items).count() == 0


def test_toxicity_of_odd_rows_and_ties(spark, odd, none):
    all_alike = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, 0.0)
    assert toxicity.toxic_documents(odd, all_alike).count() == 0  # at the threshold isn't above
    assert toxicity.without_toxic(odd, all_alike).count() == odd.count()
    high = toxicity.Model(np.zeros(toxicity.BUCKETS), 1.0, 0.0)
    got = sorted((r.doc_id or 0, r.score) for r in toxicity.toxic_documents(odd, high).collect())
    assert [d for d, _ in got] == [0, 4, 4, 5, 5, 6, 7, 8, 10] and {s for _, s in got} == {1.0}
    kept = sorted((r.doc_id or 0) for r in toxicity.without_toxic(odd, high).select("doc_id").collect())
    assert kept == [0, 1, 2, 3, 9]
    assert toxicity.toxic_documents(none, high).count() == 0 and toxicity.without_toxic(none, high).count() == 0
    assert toxicity.best_threshold(np.array([1.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])) == 1.5
    assert toxicity.best_threshold(np.array([1.0, 2.0]), np.array([1, 1])) == np.inf


def naive_differencing(sizes, k):
    """Partial partitions as sorted lists of (sum, members); the two of largest spread meet."""
    parts = [[(int(s), [i])] + [(0, []) for _ in range(k - 1)] for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, b[::-1])), key=lambda p: -p[0]))
    return [s for s, _ in parts[0]] if parts else [0] * k


@pytest.mark.parametrize("k", [2, 3, 8])
def test_differencing_is_the_naive_one(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, k - 1, k, 5 * k, 60):
        # powers of two times odd numbers keep spreads apart, so that ties can't be broken differently
        x = np.sort(rng.choice(10**9, n, replace=False).astype(np.int64))[::-1]
        want = sorted(naive_differencing(x, k))
        assert sorted(sharding.one_group_each(x, k)[0].tolist()) == want
        dense = np.zeros((n, k), np.int64)
        dense[:, 0] = x
        assert sorted(sharding.differencing(dense)[0].tolist()) == want


@pytest.mark.parametrize("fan", [2, 3, 4096])
def test_levels_of_differencing(spark, docs, fan):
    rows = sharding.sharded(docs, shards=8, bucket_groups=50, fan=fan).collect()
    size, of = np.zeros(8), {}
    for r in rows:
        size[r.shard] += r.n_bytes
        assert of.setdefault(r.group, r.shard) == r.shard
    whole = np.sort(np.array(list({r.group: sum(x.n_bytes for x in rows if x.group == r.group) for r in rows}.values())))[::-1]
    assert len(rows) == docs.count() and size.max() <= 1.05 * sharding.one_group_each(whole, 8)[0].max()


def test_sharding_ties_and_empty(spark, none):
    df = spark.createDataFrame([(i, f"text {i:03d}") for i in range(96)] + [(None, None), (None, None), (7, "")], "doc_id long, text string")
    a, b = (sorted(map(tuple, sharding.sharded(x, shards=4, bucket_groups=10).collect()), key=str) for x in (df, df.repartition(3)))
    assert a == b and len(a) == 99
    assert {sum(n for _, _, n, s in a if s == k) for k in range(4)} == {24 * 8}
    assert sharding.sharded(none).count() == 0


def test_packing_ties(spark, none):
    text = "one two three four five six seven eight " * 50
    df = spark.createDataFrame([(i % 40, text) for i in range(200)] + [(None, text)] * 30, "doc_id long, text string")
    a, b = (sorted(map(tuple, packing.packed(x).collect()), key=str) for x in (df, df.repartition(5)))
    assert a == b and len(a) == 230
    full = {}
    for _, _, _, length, bin_ in a:
        full[bin_] = full.get(bin_, 0) + length
    assert max(full.values()) <= packing.CAPACITY and sorted(full) == list(range(len(full)))


def test_column_generation_converges():
    rng = np.random.default_rng(1)
    size = np.arange(1, 129)
    patterns, used, bound = packing.plan(size, rng.integers(1, 10**7, 128), 128)
    assert used.sum() - bound <= 1e-4 * bound + 130


def test_cut_ties_are_boilerplate():
    assert list(html_extract.min_cut([1.0], [1.0], [])) == [False]


def test_long_page_is_cut_whole():
    page = "<html><body>" + "<p>" + "A plain sentence of prose, with some words. " * 20 + "</p>" * 1 + "<p>x</p>" * 20_000 + "</body></html>"
    text, n, kept = html_extract.extract(page, html_extract.DEFAULT)
    assert n == 20_001 and kept <= n


def test_subtrees_are_counted(spark):
    one = spark.range(3000).select(F.lit(-1).cast("long").alias("fp"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "SUBTREE", 1000)
        assert simhash.subtree_depth(one) == simhash.PROBE + 2  # one fingerprint can't be split
        assert simhash.subtree_depth(spark.range(3000).select(F.xxhash64("id").alias("fp"))) == 3
    assert simhash.subtree_depth(one.limit(0)) == 3


def test_near_duplicates_with_deeper_subtrees(spark, docs):
    want = {(r.doc_id, r.keep_id) for r in simhash.near_duplicates(docs).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "SUBTREE", 40)
        assert {(r.doc_id, r.keep_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_pipeline_of_an_empty_corpus(spark, none, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 5 is a copy of 4 and its other row goes with it; 1, 2 and 3 have no tokens, or white space only
    assert {4, 6, 7, 8, 9, 10, None} <= got and not got & {1, 2}


def test_settings_come_back_and_tables_go(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), settings(spark, spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    df, path = stored(spark.range(3), "x")
    assert df.count() == 3 and Path(path.removeprefix("file://")).exists()
    remove(spark, path)
    assert not Path(path.removeprefix("file://")).exists()


def test_line_runs_leave_no_tables(spark, docs):
    from spindrift.llm import line_dedup

    before = {r.tableName for r in spark.sql("show tables").collect()}
    line_dedup.deduplicated(docs, batches=7, fanout=2).count()
    assert {r.tableName for r in spark.sql("show tables").collect()} == before
    rows = lambda n, f: sorted(map(tuple, line_dedup.deduplicated(docs, batches=n, fanout=f).collect()))
    assert rows(1, 3) == rows(7, 2) == rows(4, 3)
