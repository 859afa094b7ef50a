"""License scans by canonical digests, in DataFrame functions only.

A text becomes canonical: case folded, copyright lines dropped, equivalent spellings unified, everything but letters and
digits taken as one blank. The digest of the whole canonical text, and of each of its lines, is hash-joined to the
digests of known licenses and notices; nothing is searched within a line, so a mere mention isn't a find.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut

#: Known digests up to this number are broadcast (about 100 bytes each); beyond it the join shuffles.
BROADCAST_KNOWN = 50_000
#: Lines that name a holder; a wrapped sentence may well start a line with the mere word.
COPYRIGHT = r"^[^\p{L}\p{N}\n(©]*(copyright[ \t]*(\(c\)|©|\d{4}|by\b|:)|\(c\)|©|all rights reserved)[^\n]*$"
#: Spellings that count as equal, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("https://", "http://"), ("&", " and "),
)

#: Texts of licenses and notices.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)
ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", MIT_GRANT),
    ("MIT", "MIT License\n\n" + MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT_GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + ISC_DISCLAIMER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
#: Whole texts, a file for each license, named by its SPDX id.
TEXTS = Path(__file__).parent / "license_texts"
TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License")}
#: Where the advice on how to use a license begins, which is often left out.
APPENDICES = ("APPENDIX: How to apply", "How to Apply These Terms")


def canonical(text: Column) -> Column:
    """Canonical lines, joined by newlines."""
    out = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT, "")
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def whole(canon: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(canon, "\n", " "), " +", " "))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole texts in license_texts, in their usual forms: with a title, without an appendix."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        out.append((name, text))
        if name in TITLES:
            bullets = re.sub(r"(?m)^\s*\d+\.", "*", text)
            out += [(name, head + body) for head in ("", *(t + "\n\n" for t in TITLES[name])) for body in (text, bullets)]
        for end in APPENDICES:
            if end in text:
                out.append((name, text[: text.index(end)]))
                out.append((name, text[: text.index(end)].replace("END OF TERMS AND CONDITIONS", "")))
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *whole_texts()], "license string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, notices) for every row of docs.

    known: license, text. license: the known license that the whole text is, else null. notices: the licenses whose
    known text is a whole line of the text, distinct and sorted, joined by commas; empty if there are none. A known text
    that stands for two licenses gives the first. Whole texts are read, however long. Null texts, and texts whose canonical form is empty, match nothing.
    Repeated rows give repeated results, empty tables empty ones. Other columns are left out, so their names can't clash.
    """
    listed = known.select("license", whole(canonical(F.col("text"))).alias("canon")).filter("canon <> ''")
    listed = cut(listed.groupBy("canon").agg(F.min("license").alias("license")).select("license", F.md5(F.col("canon").cast("binary")).alias("digest"), F.length("canon").alias("size")))
    count = listed.count()
    if count <= BROADCAST_KNOWN:
        listed = F.broadcast(listed)
        # A line whose canonical length no known text has can't match; the lengths are few.
        lengths = F.array_sort(F.array(*(F.lit(r[0]) for r in listed.select("size").distinct().collect()))) if count else F.array().cast("array<int>")
    else:
        lengths = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("key"), canonical(F.col(text_col)).alias("canon"))
    lines = F.transform(F.split("canon", "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") if lengths is None else F.array_contains(lengths, F.length(x)))
    rows = cut(rows.select("doc_id", "key", F.md5(whole(F.col("canon")).cast("binary")).alias("digest"), F.array_distinct(F.transform(lines, lambda x: F.md5(x.cast("binary")))).alias("lines")))
    texts = rows.filter(F.size("lines") > 0).select("key", F.explode("lines").alias("digest")).distinct()
    notices = texts.join(listed.select("digest", "license"), "digest").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    found = rows.select("doc_id", "key", "digest").join(listed.select("digest", "license"), "digest", "left").join(notices, "key", "left")
    return found.select("doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"))
