"""Canonical digest lookup of licence texts: DataFrame functions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (left is written as right).
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "sub licence": "sublicense",
    "non commercial": "noncommercial", "authorisation": "authorization", "merchantibility": "merchantability", "organisation": "organization",
    "acknowledgement": "acknowledgment", "favour": "favor", "copyright holder": "copyright owner", "copyright holders": "copyright owner", "per cent": "percent", "https": "http",
}

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
# The texts looked up, by SPDX name; a notice is a text of one line.
LICENCES = [
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
]

# Titles that a text may be headed by.
_TITLES = {"MIT": ["MIT License", "The MIT License (MIT)", "The MIT License"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License", "The zlib/libpng License"]}
#: Notices that no licence is given.
NO_LICENCE = [("LicenseRef-All-Rights-Reserved", t) for t in ("All rights reserved.", "No license is granted.", "No part of this work may be reproduced without permission.")]


def whole_texts() -> list[tuple[str, str]]:
    """(SPDX name, text) of the files in licence_texts and of LICENCES, with and without the title and what may stand around it."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    found = [(f.stem.removesuffix("-UC"), f.read_text("utf-8")) for f in files]
    found += [(n, t.removeprefix(f"{n} License\n")) for n, t in LICENCES if n in ("MIT", "ISC", "0BSD") and "\n" in t]
    found += [(n, t.split("APPENDIX: How to apply")[0]) for n, t in found if n == "Apache-2.0"]  # the terms alone
    found += [(n, f"All rights reserved.\n{t}") for n, t in found if n in _TITLES]  # what is left of a copyright line's second half
    return found + [(n, f"{title}\n{t}") for n, t in found for title in _TITLES.get(n, [])]


#: A line is a copyright line if it opens with one of these marks; it says who holds a text, not under what terms.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright\s+(?:\(c\)|©|[0-9])|\(c\)\s*[0-9]|©)[^\n]*$"

#: So is a line of the mark and capitalised names alone.
_HOLDER = r"(?m)^[^\p{L}\p{N}\n]*Copyright(?: by)?(?: \p{Lu}(?:\.|\p{Ll}[\p{L}.'-]*)){1,5}(?: <[^>\n]*>)?[^\p{L}\p{N}\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one space for each run of anything but letters and digits, one spelling."""
    low = F.lower(F.when(text.contains("Copyright"), F.regexp_replace(text, _HOLDER, " ")).otherwise(text))
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    low = F.when(marked, F.regexp_replace(low, _COPYRIGHT, " ")).otherwise(low)
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        spaced = F.replace(spaced, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(spaced)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null if nothing of it is left."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def _mark(text: Column) -> Column:
    """The longest word of the canonical text that no respelling makes: every line with the same digest holds it."""
    made = F.array(*[F.lit(w) for w in sorted({w for v in SPELLINGS.values() for w in v.split()})])
    own = F.array_except(F.split(canonical(text), " "), made)
    return F.array_max(F.transform(own, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def known(spark: SparkSession, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, digest, mark), one row per digest; as many rows as texts are listed."""
    rows = [F.struct(F.lit(a).alias("licence"), F.lit(b).alias("text")) for a, b in licences or LICENCES + NO_LICENCE + whole_texts()]
    listed = spark.range(1).select(F.inline(F.array(*rows)))
    return listed.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min("licence").alias("licence"), F.max(_mark(F.col("text"))).alias("mark"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """key, digest, licence of the entire text (null: none), and the licences of lines that are known texts by themselves.

    A null text, and one with no letter or digit, has a null digest and matches
    nothing; repeated rows are looked up alike; an empty table gives no rows;
    other columns are left out. The lookup table is as long as the list of
    licences, so its broadcast doesn't grow with the documents.
    """
    found = known(docs.sparkSession, licences)
    whole = docs.select(F.col(key), F.col(text).alias("_text"), digest(F.col(text)).alias("digest"))
    joined = whole.join(F.broadcast(found), whole["digest"] == found["known_digest"], "left")
    table = {r["known_digest"]: r for r in found.where("known_digest is not null").collect()}  # as many entries as licences
    lookup = F.create_map(*[F.lit(x) for k in sorted(table) for x in (k, table[k]["licence"])])
    marks = {r["mark"] for r in table.values()}
    lines = F.split("_text", "\n")
    if None not in marks:  # only lines that hold a listed text's mark are digested
        lines = F.filter(lines, lambda x: F.lower(x).rlike("|".join(sorted(marks))))
    noted = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: F.try_element_at(lookup, F.coalesce(digest(x), F.lit("")))))))
    return joined.select(key, "digest", "licence", F.coalesce(noted, F.array().cast("array<string>")).alias("notices"))
