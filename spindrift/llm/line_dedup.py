"""Line deduplication over levelled sorted runs of line hashes.

The corpus comes in batches, in the order of doc_id.  What has been seen is kept like a
log-structured merge tree: runs of distinct line hashes, each a table of the shared folder
that is bucketed and sorted by hash, arranged in levels.  A batch is reduced to the first
place of each of its hashes and merge-anti-joined with the runs, which are read as sorted,
and what is new becomes a run of level 0.  When a level holds ``FANOUT`` runs they are compacted into one run of the
next level, so with B batches at most ``FANOUT - 1`` runs remain on each of log(B) levels.
A hash is in one run only, with the place where the corpus has it first.  As runs are
bucketed, joins with them shuffle the batch alone.  Runs and lines are removed once the
result is written.

Lines whose hash is first seen elsewhere are removed, and each document is put together
again from the lines that stay.  The number of batches is a parameter and doesn't change
the result; a one-off job uses few, so that the whole costs a small multiple of one pass.

A line is its text between line feeds without spaces around it, compared by two independent
64-bit hashes.  Lines of fewer than ``LEAST`` characters never count as repeated: short
lines are alike by chance.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import fresh_path, remove, settings, stored, written

LEAST = 20
BATCHES = 4
FANOUT = 3
SAMPLE = 200_000
BUCKET_LINES = 4_000_000


def first_places(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "tag", "line")).alias("at")).select("h1", "h2", "at.doc", "at.tag", "at.line")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one.  As no hash is in both, the full outer join only interleaves them."""
    names = {c: f"{c}_b" for c in ("h1", "h2", "doc", "tag", "line")}
    both = a.join(b.withColumnsRenamed(names), (F.col("h1") == F.col("h1_b")) & (F.col("h2") == F.col("h2_b")), "full")
    return both.select(*[F.coalesce(c, f"{c}_b").alias(c) for c in names])


class Runs:
    """Levelled sorted runs of (h1, h2, doc, tag, line): a line's hash and its first place.

    A run is a table of ``buckets`` files, hashed and sorted by (h1, h2).  It is read as
    sorted when ``spark.sql.legacy.bucketedTableScan.outputOrdering`` is set, so joins with
    runs neither shuffle nor sort them."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.root = fresh_path(spark, self.name)
        self.made = 0

    def _store(self, df: DataFrame) -> tuple[str, DataFrame]:
        name = f"{self.name}_{self.made}"
        self.made += 1
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name, self.spark.table(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        remove(self.spark, f"{self.root}/{name}")

    def all(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def close(self) -> None:
        for level in self.levels:
            for name, _ in level:
                self._forget(name)
        self.levels = []
        remove(self.spark, self.root)

    def add(self, batch: DataFrame) -> None:
        """The lines of a batch that no run has, as a run of level 0; full levels move up.

        Aggregating leaves the batch partitioned and sorted as the runs are."""
        fresh = first_places(batch)
        for run in self.all():
            fresh = fresh.join(run, ["h1", "h2"], "left_anti")
        new, k = self._store(fresh), 0
        while True:
            if k == len(self.levels):
                self.levels.append([])
            self.levels[k].append(new)
            if len(self.levels[k]) < self.fanout:
                return
            old, self.levels[k] = self.levels[k], []
            new, k = self._store(reduce(merged, [df for _, df in old])), k + 1
            for name, _ in old:
                self._forget(name)


def line_table(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc, tag, line): hashes and places of the lines that can be repeated; ``tag``
    is the hash of the whole text, which tells apart rows that share a doc_id."""
    lines = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    trimmed = F.trim("raw")
    return lines.where(F.char_length(trimmed) >= least).select(F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit("second"), trimmed).alias("h2"), "doc", "tag", "line")


def hot_lines(lines: DataFrame, total: int) -> DataFrame:
    """Hashes of about a ten-thousandth of all lines each, by a sample: 10,000 at most.

    They only choose the way in which repeats are found, not what is found."""
    return lines.sample(False, min(1.0, SAMPLE / total), 7).groupBy("h1", "h2").count().where(F.col("count") > SAMPLE // 10_000).select("h1", "h2")


def removed_lines(docs: DataFrame, *, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, tag, gone): the sorted numbers, from 0, of the lines that a document loses.

    Batches are ranges of doc_id with about equally many lines.  In the end every line is
    held against the first place of its hash: lines of hot hashes against a broadcast table,
    so that no task gets all of them, and the others by joins with the runs."""
    spark = docs.sparkSession
    lines, at = stored(line_table(docs, least), "lines")
    hi, total = lines.agg(F.max("doc"), F.count("*")).first()
    if hi is None:
        return spark.createDataFrame([], "doc long, tag long, gone array<int>")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_LINES))
    cuts = lines.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    ends = sorted({*cuts, hi})
    sorted_runs = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true", "spark__sql__sources__bucketing__autoBucketedScan__enabled": "false", "spark__sql__unionOutputPartitioning": "false"}
    with settings(spark, spark__sql__shuffle__partitions=buckets, **sorted_runs):
        runs = Runs(spark, buckets, fanout)
        for k, end in enumerate(ends):
            batch = lines.where(F.col("doc") <= end)
            runs.add(batch.where(F.col("doc") > ends[k - 1]) if k else batch)
        hot = F.broadcast(hot_lines(lines, total))
        named = [run.withColumnsRenamed({"doc": "first_doc", "tag": "first_tag", "line": "first_line"}) for run in runs.all()]
        places = reduce(DataFrame.unionAll, [run.join(hot, ["h1", "h2"], "left_semi") for run in named])
        rest = lines.join(hot, ["h1", "h2"], "left_anti")
        found = [lines.join(F.broadcast(places), ["h1", "h2"])] + [rest.join(run, ["h1", "h2"]) for run in named]
        later = [f.where("doc <> first_doc or tag <> first_tag or line <> first_line").select("doc", "tag", "line") for f in found]
        gone = written(reduce(DataFrame.unionAll, later).groupBy("doc", "tag").agg(F.array_sort(F.collect_set("line")).alias("gone")), "gone")
        runs.close()
    remove(spark, at)
    return gone


def _without(text, gone):
    """``text`` without its lines of the sorted numbers ``gone``: the runs between them."""

    def kept(lines, cuts):
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.slice(lines, F.element_at(cuts, k) + 2, F.element_at(cuts, k + 1) - F.element_at(cuts, k) - 1)))

    split = F.array(F.struct(F.split(text, "\n").alias("l"), gone.alias("g")))
    bound = F.transform(split, lambda s: F.struct(s["l"].alias("l"), F.concat(F.array(F.lit(-1)), s["g"], F.array(F.size(s["l"]))).alias("c")))
    return F.element_at(F.transform(bound, lambda s: F.array_join(kept(s["l"], s["c"]), "\n")), 1)


def deduplicated(docs: DataFrame, *, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, text, removed): every document with the lines that it has first.

    The order of lines is by doc_id, then by place in the document; of equal lines the
    first stays.  ``removed`` counts the lines taken away; the others stay as they were, in
    their order, with one line feed between them.  A document may be left with empty text.

    Null texts stay null, empty texts empty; an empty table gives an empty result.  Texts
    and lines of any length are looked at whole.  Rows without doc_id have no place in the
    order: they stay as they are and don't make other lines repeated.  Rows that repeat both doc_id and text are
    one document and lose the same lines; rows of one doc_id with different texts are
    documents in the order of their texts' hashes.  Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = removed_lines(docs, least=least, batches=batches, fanout=fanout)
    both = docs.join(gone, (docs["doc_id"] == gone["doc"]) & (F.xxhash64(docs["text"]) == gone["tag"]), "left")
    return both.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
    )


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, ``text`` deduplicated by line and ``n_chars`` counted
    again where the text changed.  Documents that had text and have only blank lines left
    go; all others stay.  Nulls and repeated rows as in ``deduplicated``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = removed_lines(narrow, **options)
    fresh = uuid.uuid4().hex[:8]
    gone = gone.select(F.col("doc").alias(f"doc_{fresh}"), F.col("tag").alias(f"tag_{fresh}"), F.col("gone").alias(f"gone_{fresh}"))
    both = docs.join(gone, (docs["doc_id"].cast("long") == gone[f"doc_{fresh}"]) & (F.xxhash64(docs["text"].cast("string")) == gone[f"tag_{fresh}"]), "left")
    lost = F.col(f"gone_{fresh}")
    text = F.when(lost.isNull(), F.col("text")).otherwise(_without(F.col("text"), lost))
    both = both.withColumn("text", text).where(lost.isNull() | (F.trim(F.regexp_replace("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(lost.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return both.select(*docs.columns)


ORACLE = f"""
with s as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
 l as (select doc_id, unnest(ls) as raw, unnest(range(len(ls))) as line from s where text is not null),
 r as (select *, case when length(trim(raw, ' ')) >= {LEAST} then row_number() over (partition by trim(raw, ' ') order by doc_id, line) else 1 end as k from l),
 g as (select doc_id, coalesce(string_agg(raw, chr(10) order by line) filter (where k = 1), '') as text, cast(count(*) filter (where k > 1) as integer) as removed from r group by doc_id)
select s.doc_id as doc_id, case when g.doc_id is null then s.text else g.text end as text, coalesce(g.removed, 0) as removed
from s left join g on s.doc_id = g.doc_id
"""
