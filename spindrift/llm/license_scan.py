"""Licence scan by canonical digests.

A text is brought to a canonical form in which equal licences are equal: copyright
statements at the start of a line are dropped, case is folded, everything but letters and digits becomes
one space, and equivalent spellings become one.  The digest of the canonical form is
hash-joined to the digests of known licences.  Two kinds of text are looked up: whole
documents, and each line of a document, as short notices stand on a line of their own.

All of it is built-in functions.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.license_digests import DIGESTS
from spindrift.llm.license_texts import LICENSES

# what the SQL drops, whole lines; the code drops statements only
_COPYRIGHT = r"^[ \t]*(copyright|\(c\)|©)[^\n]*"
_YEAR = r"[<\[{(]?(?:[0-9]{4}|(?i:yyyy|year))"
_OPENING = r"permission[ \t]+(?:is|to)[ \t]|redistribution[ \t]+and[ \t]+use|(?:licensed|released)[ \t]+under|this[ \t]+(?:software|program|work|library|file)[ \t]+is[ \t]|everyone[ \t]+is[ \t]+permitted"
# copyright with a sign, a year or a name, or a sign with a year, up to the words that open a licence
_STATEMENT = (
    r"^[ \t]*(?:(?i:copyright)[ \t:]*(?:(?i:\(c\))|©|" + _YEAR + r"|(?i:by)[ \t]+[A-Z])"
    r"|Copyright[ \t]+(?!(?i:licen[cs]e|notice|law|act\b|right|holder|owner|statement|interest|treat|office))[A-Z<\[{]"
    r"|©|(?i:\(c\))(?:[ \t]*(?i:copyright)\b|(?=[^\n]*\b(?:19|20)[0-9]{2}\b)))"
    r"[^\n]*?(?=(?i:" + _OPENING + r")|$)"
)
_RIGHTS = r"^[ \t]*all rights reserved[. \t]*$"
_OTHER = r"[^\p{L}\p{N}]+"
_OTHER_INSIDE = r"[^\p{L}\p{N}\n]+"
#: (spelling, spelling that stands for both); none makes a text longer
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("initialise", "initialize"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("per cent", "percent"),
    ("fulfill", "fulfil"),
    ("judgement", "judgment"),
    ("https www", "http www"),
)

MOST_BROADCAST = 1_000_000


def canonical(text: str) -> str:
    """The canonical form, in Python; used for the known texts."""
    t = re.sub(_STATEMENT, " ", text, flags=re.M).lower()
    t = re.sub(_RIGHTS, " ", t, flags=re.M)
    t = re.sub(r"[\W_]+", " ", t).strip()
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t


def _plain(text: Column) -> Column:
    """Canonical but for the spellings, with the line feeds kept."""
    t = F.lower(F.regexp_replace(text, "(?m)" + _STATEMENT, " "))
    t = F.regexp_replace(t, "(?m)" + _RIGHTS, " ")
    return F.regexp_replace(t, _OTHER_INSIDE, " ")


def _spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical_units(text: Column) -> Column:
    """The canonical forms of a text and its lines: element 0 is the whole, k + 1 line k.

    All expressions work inside a line, so they run once, over the whole text."""
    lines = F.transform(F.split(_plain(text), "\n"), lambda x: F.trim(x))
    once = F.transform(F.array(lines), lambda t: F.concat(F.array(F.array_join(F.filter(t, lambda x: x != ""), " ")), t))
    return F.transform(F.flatten(once), _spelled)


def known(licenses=LICENSES) -> list[tuple[str, str, int]]:
    """(digest, identifier, characters of the canonical form), each digest once."""
    out = {}
    for name, text in licenses:
        c = canonical(text)
        out.setdefault(hashlib.md5(c.encode()).hexdigest(), (name, len(c)))
    return [(d, n, s) for d, (n, s) in out.items()]


def scanned(docs: DataFrame, licenses=LICENSES, digests=DIGESTS) -> DataFrame:
    """(doc_id, scope, line, license): every known licence that a document is or has.

    Known are the texts of ``licenses`` and, by digest alone, those of ``digests``, as
    (identifier, digest, characters of the canonical form).

    ``scope`` is ``document``, where the whole text is the licence (``line`` is -1 then), or
    ``line``, where the line of that number, from 0, is.  A document of a single line can
    have both.  Copyright statements are no part of a licence's text; a line that merely goes on
    with "copyright notice" is.

    Null and empty texts match nothing.  Texts and lines of any length are looked up whole.
    Rows without doc_id are reported with a null doc_id, repeated rows each.  Other columns
    are not looked at.  An empty table gives an empty result.

    Documents are scanned once and brought to canonical form once; only forms as long as
    that of a known licence are hashed.  The known digests are broadcast while they are
    fewer than ``MOST_BROADCAST``, and joined as Spark sees fit beyond.
    """
    spark = docs.sparkSession
    table = {d: (n, s) for n, d, s in digests} | {d: (n, s) for d, n, s in known(licenses)}
    lengths = F.array(*[F.lit(s) for s in sorted({s for _, s in table.values()})])
    digests = spark.createDataFrame([(d, n) for d, (n, _) in table.items()], "digest string, license string")
    if len(table) < MOST_BROADCAST:
        digests = F.broadcast(digests)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    units = docs.select("doc_id", F.posexplode(canonical_units(F.col("text"))).alias("k", "unit")).where(F.array_contains(lengths, F.char_length("unit")))
    hashed = units.select("doc_id", F.when(F.col("k") == 0, "document").otherwise("line").alias("scope"), F.greatest(F.col("k") - 1, F.lit(-1)).alias("line"), F.md5("unit").alias("digest"))
    return hashed.join(digests, "digest").select("doc_id", "scope", "line", "license")


def _sql_canonical(text: str) -> str:
    t = f"lower({text})"
    t = f"regexp_replace({t}, '(?m){_COPYRIGHT}', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m){_RIGHTS}', ' ', 'g')"
    t = f"trim(regexp_replace({t}, '{_OTHER}', ' ', 'g'))"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return t


ORACLE = f"""
with k(digest, license) as (values {", ".join(f"('{d}', '{n}')" for d, n, _ in known())}),
 u as (select doc_id, 'document' as scope, -1 as line, text as unit from documents
  union all select doc_id, 'line', cast(unnest(range(len(ls))) as integer), unnest(ls) from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null) s)
select doc_id, scope, line, license from (select doc_id, scope, line, md5({_sql_canonical("unit")}) as digest from u where unit is not null) h join k on h.digest = k.digest
"""
