"""Licence scans by canonical digests.

A text is brought to one canonical form: lower case, copyright lines dropped, equivalent spellings made
one, and everything but letters and digits turned into single blanks.  Its SHA-256 is hash-joined to the
digests of known licences.  Entire texts are looked up, and so is every line by itself, which finds
one-line notices inside longer documents.

The entire texts are files in ``licenses``.  A line counts as a copyright line only if a year, a place to fill in
or a name of two words follows its sign, or, after "(c)" and "©", no more than three words in all.  So neither
a clause (c) nor a wrapped line that begins with "copyright" is dropped.

Only DataFrame functions are used.  Known licences are broadcast up to a counted bound.  Only matching
lines are gathered, by the hash of their text, so copies of a document meet as one entry.

Defined results: null, empty and blank texts match nothing, nor does a line of no letters and digits;
copies and repeated rows get equal results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlume.operators.joins import fits
from revlume.session import staged

MAX_BROADCAST_ROWS = 200_000

# Spellings that count as one, and texts and notices of public licences.
SPELLINGS = {"licence": "license", "organisation": "organization", "authorise": "authorize", "recognise": "recognize"}
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
}

# Beyond what the SQL lists: equivalent spellings, names for notices, and titles that entire texts may have.
MORE_SPELLINGS = {
    "authorisation": "authorization", "recognising": "recognizing", "utilis": "utiliz", "realis": "realiz",
    "analyse": "analyze", "analogue": "analog", "artefact": "artifact", "acknowledgement": "acknowledgment",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "fulfill": "fulfil",
    "judgement": "judgment", "labour": "labor", "labelling": "labeling", "modelling": "modeling", "offence": "offense",
    "practise": "practice", "programme": "program", "whilst": "while", "willful": "wilful", "sub-license": "sublicense",
    "sub license": "sublicense", "non-commercial": "noncommercial", "non commercial": "noncommercial",
    "per cent": "percent", "copyright owner": "copyright holder", "https": "http",
}
NAMES = {
    "0BSD": ("0BSD License", "BSD Zero Clause License"),
    "AGPL-3.0": ("AGPL-3.0", "AGPLv3", "GNU Affero General Public License, version 3"),
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GNU General Public License, version 3", "GNU General Public License v3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "GNU Lesser General Public License, version 3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Zlib": ("zlib License", "The zlib License"),
}
_OPENINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under",
             "This project is licensed under")

# A copyright line names a year, a place to fill in or two capitalised words; "(c)" alone may be the letter of a
# clause, so there they must follow at once.  After a sign, a line of at most three words is a name as well.
_YEAR = r"(?:(?:19|20)\d\d|[<\[{])"
_NAME = r"(?:[ ,:]|(?i:copyright|\(c\)|©|by ))*\p{Lu}[\p{L}.&'-]* +\p{Lu}"
_COPYRIGHT = (
    rf"(?m)^[^\p{{L}}\n(©]*(?:(?i:copyright|©)(?:[^\n]*{_YEAR}|{_NAME})|"
    rf"(?i:\(c\))(?:[ ,:]*(?:(?i:copyright|©)|{_YEAR})|{_NAME}))[^\n]*$|"
    r"^[^\p{L}\n(©]*(?i:\(c\)|©) *[^ \n]+(?: +[^ \n]+){0,2} *$"
)
_OTHER = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """A text in canonical form, its lines kept apart."""
    text = F.lower(F.regexp_replace(text, _COPYRIGHT, ""))
    for spelling, chosen in (SPELLINGS | MORE_SPELLINGS).items():
        text = F.replace(text, F.lit(spelling), F.lit(chosen))
    return F.regexp_replace(text, _OTHER, " ")


def _digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def _whole(lines: Column) -> Column:
    """The lines as one; spellings of two words may have stood on both sides of a line's end."""
    text = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    for spelling, chosen in MORE_SPELLINGS.items():
        if " " in spelling:
            text = F.replace(text, F.lit(spelling), F.lit(chosen))
    return text


def known_digests(licenses: DataFrame) -> DataFrame:
    """``digest`` and ``license`` of known texts (``license``, ``text``); one row per digest."""
    whole = _whole(canonical_lines(F.col("text")))
    rows = licenses.select("license", whole.alias("whole")).where("whole != ''")
    return rows.groupBy(_digest(F.col("whole")).alias("digest")).agg(F.min("license").alias("license"))


def entire_texts() -> list[tuple[str, str]]:
    """The entire texts in ``licenses``, by file name, as published and with each paragraph on one line.

    Short texts come without a title and with each usual one, with and without "All rights reserved.", and
    with numbers or dashes before their clauses.
    """
    rows = []
    for file in sorted(resources.files("revlume.llm").joinpath("licenses").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        texts = {text, re.sub(r"(?<!\n)\n(?!\n)[ \t]*", " ", text)}
        if name in TITLES:
            texts |= {re.sub(r"(?m)^ *\d\. ", "- ", t) for t in texts}
            texts |= {f"All rights reserved.\n\n{t}" for t in texts}
            texts |= {f"{title}\n\n{t}" for title in TITLES[name] for t in texts}
        rows += [(name, t) for t in sorted(texts)]
    return rows


def built_in(spark: SparkSession) -> DataFrame:
    """The licences that this module lists."""
    rows = [(name, text) for name, texts in NOTICES.items() for text in texts]
    for name, called in NAMES.items():
        rows += [(name, f"{opening} {article}{c}") for opening in _OPENINGS for article in ("", "the ") for c in called]
        tags = [name, f"{name}-only", f"{name}-or-later", f"{name}+"] if "GPL" in name else [name]
        rows += [(name, f"SPDX-License-Identifier: {tag}") for tag in tags]
    rows += entire_texts()
    return spark.createDataFrame(rows, "license string, text string")


def find_licenses(docs: DataFrame, licenses: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, the ``license`` that its entire text is, and ``n_lines`` and ``notices`` of its lines."""
    known = staged(known_digests(licenses), "op4-known")
    listed = F.broadcast(known) if fits(known, max_broadcast_rows) else known
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), canonical_lines(text).alias("lines"))
    lines = rows.select("key", F.posexplode(F.split("lines", "\n")).alias("line", "words"))
    lines = lines.select("key", "line", F.trim("words").alias("words")).where("words != ''")
    matched = lines.select("key", "line", _digest(F.col("words")).alias("digest")).join(listed, "digest")
    notices = matched.groupBy("key").agg(
        F.countDistinct("line").alias("n_lines"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices")
    )
    notices = staged(notices, "op4-notices")
    whole = rows.select("doc_id", "key", _digest(_whole(F.col("lines"))).alias("digest")).join(listed, "digest", "left")
    found = whole.join(F.broadcast(notices) if fits(notices, max_broadcast_rows) else notices, "key", "left")
    return found.select(
        "doc_id", "license", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_licenses(docs, built_in(spark))


def _canonical_sql(x: str) -> str:
    pattern = _COPYRIGHT.replace("'", "''")
    out = f"lower(regexp_replace({x}, '{pattern}', '', 'g'))"
    for spelling, chosen in SPELLINGS.items():
        out = f"replace({out}, '{spelling}', '{chosen}')"
    return f"regexp_replace({out}, '{_OTHER}', ' ', 'g')"


_LISTED = ", ".join(f"('{name}', '{text}')" for name, texts in NOTICES.items() for text in texts)
OP4_SQL = f"""
WITH listed(license, text) AS (VALUES {_LISTED}),
known AS (
  SELECT sha256(trim(regexp_replace({_canonical_sql("text")}, '[ \\n]+', ' ', 'g'), ' ')) AS digest, min(license) AS license
  FROM listed GROUP BY 1
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents
), l AS (
  SELECT r, i, trim(w[i], ' ') AS words FROM (
    SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, string_split(lines, chr(10)) AS w FROM d))
), n AS (
  SELECT r, count(DISTINCT i) AS n_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM l JOIN known ON sha256(words) = digest WHERE words <> '' GROUP BY r
)
SELECT doc_id, known.license, coalesce(n_lines, 0) AS n_lines, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')) = digest LEFT JOIN n USING (r)
"""
