"""Queries over the corpus tables, one for each operator, and their SQL where it exists."""

from __future__ import annotations

from spindrift.llm import decontaminate, html_extract, license_scan, line_dedup, packing, quality, sharding, simhash, toxicity, wavelet
from spindrift.llm.common import table


def op1_html_extract(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op2_license_scan(spark, sf_dir):
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_wavelet_tokens(spark, sf_dir):
    return wavelet.wavelet_shards(table(spark, sf_dir, "documents"))


def op5_quality_lines(spark, sf_dir):
    return quality.cleaned(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op7_kk_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_simhash_neardup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract,
        op2_license_scan,
        op3_decontaminate,
        op4_wavelet_tokens,
        op5_quality_lines,
        op6_toxicity,
        op7_kk_sharding,
        op8_simhash_neardup,
        op9_packing,
        op10_line_dedup,
    )
}

ORACLES = {
    "op2_license_scan": license_scan.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_quality_lines": quality.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
