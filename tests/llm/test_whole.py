"""Results that a bound in the code used to cut."""

import random
import re
import textwrap
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.llm import html_extract, license_scan, line_dedup, quality, queries
from spindrift.llm.common import table
from spindrift.llm.license_texts import LICENSES
from tests.oracle import compare


def passing(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, x string")
    return [r.ok for r in df.select("i", quality.line_passes(F.col("x")).alias("ok")).orderBy("i").collect()]


def test_long_menus_and_notices_fail(spark):
    many = 50_000
    bad = ["label one | label two" + " | and more" * many, "a > b" + " > c d" * 100 + " >", "home " * many + "| contact us", "https://" + "x" * 401, "words of prose " * many + "All rights reserved."]
    good = ["label one | label two" + " | and more" * many + " | " + "x" * 31, "home " * many + "improvement", "words of prose, " * many, "1" * many + " words"]
    assert passing(spark, bad) == [False] * len(bad)
    assert passing(spark, good) == [True] * len(good)


def test_linear_expressions_match_the_same_lines(spark):
    pieces = ["a", "home", "about", "about us", "contact us", "prev", "us", " | ", " > ", "| ", " |", " ", "  ", "12", "page 1", " of ", "x" * 15, "x" * 30, "»", "next", ".", "log in"]
    lines = spark.range(60_000).select(F.concat(*[F.element_at(F.array(*map(F.lit, pieces)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(pieces))) + 1).cast("int")) for k in range(7)]).alias("x"))
    lines = lines.unionAll(lines.select(F.concat(F.lit("a | b"), F.expr("substring(x, 1, 20)"), F.lit(" | c")))).unionAll(lines.select(F.regexp_replace("x", "[^ |>»]{3,}", "home")))
    found = lines.select(F.trim("x").alias("x")).select(F.col("x").rlike(quality.NAVIGATION).alias("a"), F.col("x").rlike(quality._LINEAR_NAVIGATION).alias("b"))
    n = {(r.a, r.b): r["count"] for r in found.groupBy("a", "b").count().collect()}
    assert set(n) == {(True, True), (False, False)} and n[True, True] > 500


def test_quality_is_the_sql_without_its_length_limit(spark):
    limit = "length(trim(x, ' ')) <= 400 and "
    assert queries.ORACLES["op5_quality_lines"].count(limit) == 2
    compare(spark, "op5", queries.op5_quality_lines, queries.ORACLES["op5_quality_lines"].replace(limit, ""))


@pytest.mark.parametrize("kind", ["characters", "pieces"])
def test_quality_judges_short_lines_as_the_sql(spark, kind):
    if kind == "characters":
        lines = [chr(c) for c in range(1, 0x110000) if c != 10 and not 0xD800 <= c < 0xE000]
    else:
        pieces = ["a", "HOME", "about uſ", "bac\N{KELVIN SIGN}", "ſearch", "PÁGINA 3", "Seite 4", " von ", "page 1", "12", " | ", " > ", " |", "»", " ", "\r", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u2029"]
        pieces += ["https://a.de/b", "read more", "…", "x" * 15, "x" * 30, "© ", "all rights ", "reſerved", "COO\N{KELVIN SIGN}IE POLICY", "prıvacy policy", "PRİVACY POLICY", "~", "\u0870", "\U0001f600"]
        r = random.Random(1)
        lines = ["".join(r.choices(pieces, k=r.randint(1, 5))) for _ in range(10_000)]
        lines += [f"{a}{b}{a}" for a in pieces for b in pieces]
    assert max(map(len, lines)) <= 400
    many = 1000 if kind == "characters" else 50
    docs = pd.DataFrame([(i, "\n".join(["words of prose " * 150, *lines[i : i + many]])) for i in range(0, len(lines), many)], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", docs)
    judged = lambda df: {r.doc_id: (r.lines_removed, r.text) for r in df.itertuples()}
    got, want = judged(quality.cleaned(spark.createDataFrame(docs)).toPandas()), judged(con.sql(queries.ORACLES["op5_quality_lines"]).df())
    assert len(want) == len(docs) and sum(n for n, _ in want.values()) > 1000
    assert [i for i in want if got.get(i) != want[i]] == []


def test_least_of_one_removes_every_repeat(spark):
    limit = f">= {line_dedup.LEAST} "
    assert queries.ORACLES["op10_line_dedup"].count(limit) == 1
    compare(spark, "op10", lambda s, d: line_dedup.deduplicated(table(s, d, "documents"), least=1), queries.ORACLES["op10_line_dedup"].replace(limit, ">= 1 "))


def wrapped(text, width):
    return "\n".join(textwrap.fill(line, width, break_on_hyphens=False, break_long_words=False) for line in text.split("\n"))


def test_licenses_match_at_any_line_width(spark):
    full = [(n, t) for n, t in LICENSES if len(t) > 400]
    heads = ["", "Copyright (c) 2020 Jane Doe\n\n", "Copyright 1999-2003, The Foo Authors. All rights reserved.\n", "Copyright Jane Doe\n", "© Jane Doe\n", "(c) Jane Doe 2011\n", "Copyright (c) <year> <owner>. "]
    rows, want = [], set()
    for n, t in full:
        for width in (*range(40, 101, 3), 10_000):
            for head in heads if width == 10_000 else heads[:2]:
                if head.endswith(" ") and not t.startswith(("Permission", "Redistribution", "Licensed", "This software is")):
                    continue
                want.add((len(rows), n))
                rows.append((len(rows), head + wrapped(t, width)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in license_scan.scanned(df).where("scope = 'document'").collect()}
    assert got == want


@pytest.mark.parametrize("line", ["copyright notice and this", "COPYRIGHT HOLDERS AND", "copyright owner or", "Copyright License. Subject to", "(c) You must retain", "copyright (and only"])
def test_prose_is_no_copyright_statement(line):
    assert license_scan.canonical(line) != ""


@pytest.mark.parametrize("line", ["Copyright (c) 2020 Jane", "  copyright 2011-2013 jane", "Copyright: © Jane", "(C) 2020 Jane", "Copyright [yyyy] [name of copyright owner]", "COPYRIGHT (C) JANE", "Copyright by Jane", "(c) Copyright Jane"])
def test_copyright_statements_go(line):
    assert license_scan.canonical(line) == ""


COMMON = Path("/usr/share/common-licenses")
WHOLE = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3-only", "BSD": "BSD-3-Clause"}


def test_whole_licenses_match(spark):
    bsd = next(t for n, t in LICENSES if n == "BSD-3-Clause")
    rows = [("bullets", "BSD-3-Clause", re.sub(r"(?m)^[0-9]\. ", " * ", bsd))]
    for file, name in WHOLE.items():
        if (COMMON / file).exists():
            text = (COMMON / file).read_text()
            rows.append((file, name, text))
            if file in ("Apache-2.0", "GPL-2", "GPL-3"):
                rows.append((file + " without appendix", name, text[: text.index("END OF TERMS AND CONDITIONS")]))
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {rows[r.doc_id][0]: r.license for r in license_scan.scanned(df).where("scope = 'document'").collect()}
    assert got == {what: name for what, name, _ in rows}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>T</title><body><p>content", ["content"]),
        ("<html><head><meta charset=utf-8><title>How <div> works</title><script>w('<p>x</p>')</script><p>content", ["content"]),
        ("<head><title>T</title>content<p>more", ["content", "more"]),
        ("<head><style>p{}</style></head><header>top</header><p>content", ["top", "content"]),
        ("<p>one<svg class='i' /><p>two<svg><text>no</text></svg><p>three", ["one", "two", "three"]),
        ("<p>one<svg><p>two", ["one", "two"]),
        ("<p>one<template><noscript><p>two<svg-icon><p>three", ["one", "two", "three"]),
        ("<p>one<script>var x = '<p>no'", ["one"]),
        ("<p>one" + "<svg><template>" * 50_000 + "<p>two", ["one", "two"]),
    ],
)
def test_missing_end_tags_lose_no_text(page, want):
    assert html_extract.blocks(page)[0] == want
