"""Licence scans by lookup of canonical digests, in DataFrame functions only.

A text is brought, line by line, to a canonical form (lower case, equivalent spellings,
no copyright lines, no punctuation, single spaces), and the digest of the entire form
is hash-joined to the digests of known licences. The same is done with each
line, as an entire text of its own, for notices inside longer documents.

Edge cases: a null text is empty; an empty canonical form matches nothing;
repeated rows each get the result of their text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copyright statements, in the form without punctuation: to the end of the line or to the opening of a licence behind it.
STATEMENT = r"(?:portions )?copyright (?:c |by |[0-9]{4}).*?( (?:permission is hereby granted|permission to use copy|redistribution and use|(?:this work is |this file is )?licensed under|released under|distributed under) .*|$)"
COPYRIGHT_LINE = r"^(?:c [0-9]{4} |(?:all|alle) rights? reserved$)"
#: Fixed spellings that count as equal, replaced in this order in lower-case words that have a space on each side of their own.
SPELLINGS = [
    ("licenc", "licens"), (" version ", ""), (" the ", ""), (" https ", ""), (" http ", ""), (" sub  licens", " sublicens"), (" non  commercial", " noncommercial"),
    (" open  source ", " opensource "), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"), (" fulfil ", " fulfill "),
]
#: So many known texts at most are sent to all tasks; more are joined by shuffling.
BROADCAST_ROWS = 50_000
GRANTS = ["licensed under {}", "this work is licensed under {}", "released under {}", "distributed under {}", "this file is licensed under {}", "spdx-license-identifier: {}", "license: {}"]
#: Fixed names of licences, by identifier.
NAMES = {
    "MIT": ["MIT License", "MIT"], "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GPL-3.0"], "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GPL-2.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"], "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"], "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"], "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"], "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"],
}
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
    "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
    "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit "
    "of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
    'present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
#: Fixed whole licence texts, with and without their headings.
TEXTS = {
    "MIT": ["MIT License " + _MIT_BODY, _MIT_BODY, "The MIT License (MIT) " + _MIT_BODY],
    "ISC": [f"{t}{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}" for t in ("", "ISC License ")],
    "0BSD": [f"{t}{_PERMISSION}. {_ISC_END}" for t in ("", "Zero-Clause BSD ", "BSD Zero Clause License ")],
    "BSD-2-Clause": [f"{t}{_BSD_START}{_BSD_END}" for t in ("", "BSD 2-Clause License ")],
    "BSD-3-Clause": [f"{t}{_BSD_START}{_BSD_THIRD}{_BSD_END}" for t in ("", "BSD 3-Clause License ")],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE} For more information, please refer to <https://unlicense.org>", f"{_UNLICENSE} For more information, please refer to <https://unlicense.org/>"],
}


def spelled(line: Column) -> Column:
    """Lower-case words between single spaces, in one spelling."""
    # words that follow each other don't share a space, so that each is found
    form = F.regexp_replace(F.lower(F.replace(line, F.lit("&"), F.lit(" and "))), r"[^\p{L}\p{N}]+", "  ")
    form = F.concat(F.lit(" "), form, F.lit(" "))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return F.trim(F.replace(form, F.lit("  "), F.lit(" ")))


def without_statement(form: Column) -> Column:
    return F.when(F.contains(form, F.lit("copyright ")), F.trim(F.regexp_replace(form, STATEMENT, "$1"))).otherwise(form)


def without_copyright_line(form: Column) -> Column:
    may_be = F.startswith(form, F.lit("c ")) | F.startswith(form, F.lit("all"))
    return F.when(may_be & F.regexp_like(form, F.lit(COPYRIGHT_LINE)), "").otherwise(form)


def canonical(line: Column) -> Column:
    """The form of a line that is digested; empty for copyright lines. A form is its own form."""
    return without_copyright_line(without_statement(spelled(line)))


def canonical_lines(text: Column) -> Column:
    """Canonical forms of all lines that have one. Step by step, so that each line takes each step once."""
    forms = F.split(text, "\n")
    for step in (spelled, without_statement, without_copyright_line):
        forms = F.transform(forms, step)
    return F.filter(forms, lambda x: x != "")


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the built-in list: whole texts, and notices made of names and grants."""
    rows = [(k, t) for k, ts in TEXTS.items() for t in ts]
    rows += [(k, g.format(n)) for k, names in NAMES.items() for n in names for g in GRANTS]
    return spark.createDataFrame(rows, "license string, text string")


def license_digests(known: DataFrame) -> DataFrame:
    """(license, digest); a digest two licences share goes to the first by name."""
    form = known.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("form")).where("form != ''")
    return form.groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: its digest, the licence that is its entire text, and the licences of its lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = license_digests(known)
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    # the entire text and each of its lines are looked up in one pass
    forms = docs.select("doc_id", F.xxhash64(text).alias("_h"), canonical_lines(text).alias("forms"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.md5(F.array_join("forms", " ")).alias("digest")))
    lines = F.transform(F.array_distinct("forms"), lambda f: F.struct(F.lit(False).alias("whole"), F.md5(f).alias("digest")))
    looked = forms.select("doc_id", "_h", F.inline(F.concat(whole, lines))).join(digests, "digest", "left").where("whole or license is not null")
    lines_license, whole_only = F.when(~F.col("whole"), F.col("license")), F.when(F.col("whole"), F.col("digest"))
    found = looked.groupBy("doc_id", "_h").agg(
        F.max(whole_only).alias("text_digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_sort(F.collect_set(lines_license)).alias("ids"), F.count_if("whole").alias("copies"),
    )
    out = found.select("doc_id", "text_digest", "text_license", F.array_join("ids", ",").alias("notice_licenses"), F.size("ids").cast("long").alias("n_notices"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.drop("col")
