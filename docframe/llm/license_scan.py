"""Licence scan by canonical digests; DataFrame functions only.

A text is normalised (case, punctuation, copyright lines, equivalent
spellings), hashed as a whole, and looked up among the digests of known
licence texts. Each of its lines is looked up the same way, so a notice at the
end of a longer text is found too. The known digests come from a table of
texts, normalised by the same expressions: the caller's, or whole licences and
file headers (``LICENCES``) and one-line notices (``NOTICES``).

Defined results: null and empty texts (and those of copyright lines only) have
an empty canonical form and no licence; very long texts are hashed whole; a null
id keeps its row; repeated rows are scanned each; of known texts with one digest
the least id is named; a line's licences are a set, ascending; an empty table
gives no rows, an empty table of known texts no licence. Extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.licences import LICENCES

# Short notices of common licences, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)
# Spellings that count as one, applied in this order.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("favour", "favor"), ("judgement", "judgment"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))
COPYRIGHT = r"(?m)^[^\n]*(copyright \(c\)|copyright ©|copyright [0-9]|\(c\) [0-9]|© ?[0-9]|all rights reserved)[^\n]*$"


def _spelled(x: Column) -> Column:
    """One spelling of words parted by one blank; blanks are doubled meanwhile, so that matches never share one."""
    x = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def without_copyright(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one blank between words of letters and digits, one spelling."""
    return _spelled(F.trim(F.regexp_replace(without_copyright(text), r"[^\p{L}\p{N}]+", " ")))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of known texts (license_id, text); the fixed ones where none are given."""
    if texts is None:
        rows = F.array(*[F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("text")) for a, b in (*NOTICES, *LICENCES)])
        texts = spark.range(1).select(F.explode(rows).alias("n")).select("n.license_id", "n.text")
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id", (canonical(F.col("text")) != "").alias("ok")).where("ok").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, line_licenses): one row per input row.

    Digests are hash-joined; texts are never moved. Lines that match meet their
    row again by id and text hash, so repeated ids with other texts stay apart.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    parts = F.filter(F.array_distinct(F.transform(F.split(without_copyright(F.col("text")), r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))), lambda x: x != "")
    lines = base.select("doc_id", "key", F.explode(F.transform(parts, lambda x: F.sha2(_spelled(x), 256))).alias("digest"))
    found = lines.join(known, "digest").groupBy(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).agg(F.array_sort(F.collect_set("license_id")).alias("line_licenses"))
    whole = base.select("doc_id", "key", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(known, "digest", "left")
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left").select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def oracle() -> str:
    """DuckDB SQL for ``scan`` of documents with the fixed texts; spellings are mapped word by word, pairs of words by lookahead over a list."""
    copyright_line = "[^\\n]*(copyright \\(c\\)|copyright ©|copyright [0-9]|\\(c\\) [0-9]|© ?[0-9]|all rights reserved)[^\\n]*"
    one = "map {'licence': 'license', 'licences': 'licenses', 'licenced': 'licensed', 'sublicence': 'sublicense', 'organisation': 'organization', 'acknowledgement': 'acknowledgment', 'whilst': 'while', 'favour': 'favor', 'judgement': 'judgment'}"
    two = "map {'sub license': 'sublicense', 'non commercial': 'noncommercial', 'per cent': 'percent', 'copyright owner': 'copyright holder', 'copyright owners': 'copyright holders'}"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in (*NOTICES, *LICENCES))
    return f"""
with cleaned as (
  select 'd' as kind, r, 0 as k, null::varchar as license_id, regexp_replace(lower(coalesce(text, '')), '{copyright_line}', '', 'g') as t from (select row_number() over () as r, text from documents)
  union all select 'k', row_number() over (), 0, l, regexp_replace(lower(t), '{copyright_line}', '', 'g') from (values {values}) as v(l, t)),
pieces as (select kind, r, k, license_id, t from cleaned
  union all select 'l', r, row_number() over (), null, unnest(list_distinct(string_split(t, chr(10)))) from cleaned where kind = 'd'),
words as (select kind, r, k, license_id, list_transform(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: coalesce({one}[x], x)) as w from pieces),
joined as (select kind, r, k, license_id, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case
    when {two}[w[i] || ' ' || coalesce(w[i + 1], '')] is not null then {two}[w[i] || ' ' || w[i + 1]]
    when i > 1 and {two}[w[i - 1] || ' ' || w[i]] is not null then null
    else w[i] end), lambda x: x is not null), ' ') as c from words),
known as (select sha256(c) as digest, min(license_id) as license_id from joined where kind = 'k' group by 1),
found as (select j.r, list_sort(list(distinct known.license_id)) as line_licenses from joined j join known on sha256(j.c) = known.digest where j.kind = 'l' and j.c <> '' group by 1)
select doc_id, sha256(j.c) as digest, known.license_id, coalesce(found.line_licenses, []::varchar[]) as line_licenses
from (select row_number() over () as r, doc_id from documents) d join joined j on j.kind = 'd' and j.r = d.r left join known on sha256(j.c) = known.digest left join found on found.r = d.r"""
