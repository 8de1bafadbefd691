"""Licence scan by canonical digest, in DataFrame functions only.

A text is normalised (case, copyright lines, equivalent spellings, punctuation,
white space) and its SHA-256 is looked up among the digests of known licence
texts: the full public texts in ``licence_texts``, and notices. A lookup of each
line among the notices finds those inside documents. Tables of known texts are
some dozen rows, fixed in this folder, so they are broadcast; a caller can supply
more texts and notices.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, replaced in this order.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("non-infringement", "noninfringement"), ("http://", "https://"))
_PERMISSION = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT = f'MIT License\n\nCopyright (c) <year> <holder>\n\n{_PERMISSION}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Licence id, public text or notice.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", _MIT.split("\n\n", 2)[2]),
    ("ISC", _ISC),
    ("ISC", _ISC.split("\n\n", 2)[2]),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def full_texts() -> list[tuple[str, str]]:
    """Licence id, text of the full licences in their usual forms: with and without
    a title or numbered conditions, and without what follows the terms."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        name, text = path.stem, path.read_text("utf-8")
        forms = [text]
        if "END OF TERMS AND CONDITIONS" in text:
            forms.append(text[: text.index("END OF TERMS AND CONDITIONS")])
            forms.append(forms[-1] + "END OF TERMS AND CONDITIONS")
        if name.startswith("BSD"):
            numbers = iter("123")
            forms.append(re.sub(r"(?m)^ *(?=Redistributions of|Redistributions in|Neither)", lambda m: next(numbers) + ". ", text))
            forms += [f.replace("COPYRIGHT OWNER", "COPYRIGHT HOLDER") if "COPYRIGHT OWNER" in f else f.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for f in forms]
            forms += [f"BSD {name[4]}-Clause License\n\n{f}" for f in forms]
        if name == "0BSD":
            forms += [f"{title}\n\n{text}" for title in ("BSD Zero Clause License", "Zero-Clause BSD")]
        out += [(name, f) for f in forms]
    return out


def canonical(text: Column) -> Column:
    """Lower case; copyright lines, punctuation and extra spaces gone; one spelling."""
    t = F.regexp_replace(F.lower(text), "(?m)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^0-9a-z\u0080-\U0010ffff]+", " "))


def canonical_sql(text: str) -> str:
    """The same in SQL of another engine."""
    t = f"regexp_replace(lower({text}), '(?m)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$', ' ', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '[^0-9a-z\u0080-\U0010ffff]+', ' ', 'g'))"


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """digest, licence: one row for each known text."""
    rows = spark.createDataFrame(texts, "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(spark: SparkSession, docs: DataFrame, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest, licence (of the entire text, else null), n_lines (lines
    that are known notices), line_licences (their ids, sorted, comma-joined) for
    every row. ``more`` gives further licence ids and their texts or notices.

    A null or empty text has the digest of the empty text and no licence. Rows
    that repeat a doc_id or have none are scanned row by row. Further columns are
    ignored. An empty table gives no rows."""
    notices = [*KNOWN, *(more or ())]
    table = {r.digest: r.licence for r in known(spark, notices).collect()}  # a fixed number of rows
    full = {r.digest: r.licence for r in known(spark, full_texts()).collect()} | table
    lookup = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, v)])
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    hits = F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, digest(x))), lambda x: x.isNotNull())
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("text_digest"), hits.alias("_hits"))
    whole = F.broadcast(spark.createDataFrame(sorted(full.items()), "text_digest string, licence string"))  # as many rows as known texts
    return out.join(whole, "text_digest", "left").select("doc_id", "text_digest", "licence", F.size("_hits").cast("long").alias("n_lines"), F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("line_licences"))


def oracle_sql() -> str:
    """The whole scan in SQL of another engine."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canonical_sql('t')}) AS digest, min(k) AS licence FROM (VALUES {rows}) AS v(k, t) GROUP BY 1),
whole AS (SELECT doc_id, sha256({canonical_sql("coalesce(text, '')")}) AS text_digest FROM documents),
lines AS (SELECT doc_id, sha256({canonical_sql('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0),
hits AS (SELECT doc_id, count(*) AS n_lines, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.licence, coalesce(h.n_lines, 0)::BIGINT AS n_lines, coalesce(h.line_licences, '') AS line_licences
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN hits h ON h.doc_id = w.doc_id
"""
