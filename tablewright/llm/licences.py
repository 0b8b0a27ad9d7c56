r"""Licence scan by canonical digests (DataFrame functions only).

A text is brought into a canonical form: lower case, copyright statements dropped,
equivalent spellings unified, everything but letters and digits to one space.
The SHA-256 digest of the whole canonical text is then hash-joined with the
digests of the known licences.  Texts compared are the whole document and, as
licences mostly stand in a file beside other text, each of its lines and each
of its paragraphs (between blank lines); each is compared as an entire text.

The list of known licences is a parameter and small, so its digests (of
whole public texts, ``licence_texts``, and of usual notices) are broadcast; before the digest is taken, texts whose canonical length is that of
no known licence are left out, which changes nothing, as equal digests mean
equal lengths.

Defined cases: a null or empty text matches nothing; a text that is nothing
but punctuation or copyright lines matches nothing; a licence matched several
times is named once per unit; a digest known under two names gives both;
repeated rows are all returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

#: Public licence texts and the usual notices that stand for a licence.
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
            "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
            "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE "
            "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
            "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
]
#: Whole public licence texts, one file each, named by licence (an edition may follow it: ``NAME.EDITION.txt``).
TEXTS = Path(__file__).parent / "licence_texts"


def whole_texts() -> list[tuple[str, str]]:
    """``(licence, text)`` of the whole texts, with the forms in which their files usually stand."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = re.sub(r"(\.[A-Za-z]+)?\.txt$", "", path.name), path.read_text(encoding="utf-8")
        forms = [text]
        # the appendix on how to apply the licence is often left out
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        if end:
            forms.append(text[:end.end()])
            forms.append(text[:end.start()])
        if name.startswith("BSD"):
            forms += [re.sub(r"(?m)^[0-9]\. ", "* ", t) for t in forms]
            forms += [re.sub(r"COPYRIGHT(\s+)(HOLDER|OWNER)(?=\s+OR\b)", lambda m: f"COPYRIGHT{m[1]}{'OWNER' if m[2] == 'HOLDER' else 'HOLDER'}", t) for t in forms]
            forms += ["All rights reserved.\n\n" + t for t in forms]
        if name == "Unlicense":
            forms += [text.replace("<https://unlicense.org>", "<https://unlicense.org/>"), text[:text.index("For more information")]]
        out += [(name, form) for form in dict.fromkeys(forms)]
    return out


#: Titles that often head the files of short licences.
TITLES = {"MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License"],
          "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
          "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License",
                           "New BSD License", "Modified BSD License", "BSD License", "The BSD License"],
          "Unlicense": ["The Unlicense", "Unlicense"]}


def headed(known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The whole short texts below each of their titles; "All rights reserved" may stand between the two."""
    out = []
    for name, text in known:
        if name in TITLES and len(text) > 500:
            below = [text] if text.startswith("All rights") else [text, "All rights reserved.\n\n" + text]
            out += [(name, t) for t in below[1:]] + [(name, f"{title}\n\n{t}") for title in TITLES[name] for t in below]
    return out


KNOWN += [("ISC", t.replace("and/or", "and", 1)) for n, t in KNOWN if n == "ISC"] + whole_texts()
KNOWN = list(dict.fromkeys(KNOWN + headed(KNOWN)))
#: Equivalent spellings, as (pattern, replacement) on the lower-case text.
SPELLINGS = [("-\n", "-"), ("licence", "license"), ("sub-licens", "sublicens"), ("non-infring", "noninfring"), ("organis", "organiz"),
             ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"), ("behaviour", "behavior"),
             ("programme", "program"), ("whilst", "while"), ("wilful", "willful"), ("fulfil ", "fulfill "),
             ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("per cent", "percent"), ("https:", "http:"),
             ("&", " and ")]
#: A copyright statement, as a line: with a year, a placeholder or a sign after the word, a sign with a year, or one that
#: opens a paragraph (and those right below).  A line that merely begins with the word at a wrap point of the text stays.
_LEAD = r"[^a-z0-9\n\"]*"
_STATED = (rf"copyright{_LEAD}(\(c\)|©|[0-9]|year|yyyy)|©|\(c\){_LEAD}copyright|\(c\)[^\n]*(19|20)[0-9][0-9]")
COPYRIGHT = (rf"(^|\n){_LEAD}({_STATED})[^\n]*"
             rf"|(^|\n[\x20\x09-\x0D]*\n){_LEAD}copyright[^\n]*(\n{_LEAD}copyright[^\n]*)*")


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    out = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit("\n"))
    for found, used in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(used))
    return F.trim(F.regexp_replace(out, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """``licence, digest, size`` of the known licences."""
    texts = spark.createDataFrame(known, "licence string, text string").select("licence", canonical(F.col("text")).alias("form"))
    return texts.select("licence", F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).distinct()


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, whole, lines, paragraphs, licences``.

    The arrays hold, sorted and distinct, the licences that the whole text,
    a line or a paragraph equals; ``licences`` is their union.
    """
    spark = docs.sparkSession
    listed = known_digests(spark, known or KNOWN)
    sizes = listed.agg(F.collect_set("size").alias("sizes"))
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    unit = lambda kind, c: F.transform(F.array_distinct(c), lambda t: F.struct(F.lit(kind).alias("kind"), canonical(t).alias("form")))
    units = F.concat(unit("whole", F.array("text")), unit("lines", F.split("text", "\n")),
                     unit("paragraphs", F.split("text", r"\n[\x20\x09-\x0D]*\n")))
    # the known lengths are one small row
    found = (source.filter("text IS NOT NULL").select("doc_id", "text_hash", units.alias("units"))
             .join(F.broadcast(sizes), F.lit(True), "left")
             .select("doc_id", "text_hash", F.explode(F.filter(
                 "units", lambda u: F.array_contains("sizes", F.length(u.form)) & (u.form != ""))).alias("u"))
             .select("doc_id", "text_hash", "u.kind", F.sha2("u.form", 256).alias("digest"))
             .join(F.broadcast(listed.select("licence", "digest")), "digest")
             .groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
             .agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("licence")))).alias(k)
                    for k in ("whole", "lines", "paragraphs")]))
    out = source.select("doc_id", "text_hash").join(
        found, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash")), "left")
    empty = F.expr("CAST(array() AS array<string>)")
    filled = {k: F.coalesce(k, empty) for k in ("whole", "lines", "paragraphs")}
    return out.select("doc_id", *[c.alias(k) for k, c in filled.items()],
                      F.array_sort(F.array_distinct(F.concat(*filled.values()))).alias("licences"))


def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licences found in every document; arrays as comma-separated text."""
    found = scan_licences(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.concat_ws(",", c).alias(c) for c in ("whole", "lines", "paragraphs", "licences")])


def _canonical_sql(expr: str) -> str:
    out = f"regexp_replace(lower({expr}), '{COPYRIGHT}', chr(10), 'g')"
    for found, used in SPELLINGS:
        out = f"replace({out}, '{found}', '{used}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _sql() -> str:
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    kinds = {"whole": "[text]", "lines": "string_split(text, chr(10))", "paragraphs": r"string_split_regex(text, '\n[\x20\x09-\x0D]*\n')"}
    units = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest({e}) AS unit FROM documents" for k, e in kinds.items())
    per = ", ".join(f"coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (WHERE kind = '{k}'), '') AS {k}" for k in kinds)
    return f"""
WITH k AS (SELECT DISTINCT licence, sha256({_canonical_sql('text')}) AS digest FROM (VALUES {known}) t(licence, text)),
u AS (SELECT doc_id, kind, sha256({_canonical_sql('unit')}) AS digest FROM ({units})),
m AS (SELECT doc_id, kind, licence FROM u JOIN k USING (digest))
SELECT d.doc_id, {per}, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""


QUERIES = {"op8_licence_scan": op8_licence_scan}
ORACLE = {"op8_licence_scan": _sql()}
