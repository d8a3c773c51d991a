"""Licence scan by canonical digests, in DataFrame functions only.

A text, and each of its lines, is brought to a canonical form: lower case, copyright
lines gone, punctuation to single spaces, equivalent spellings unified.  Its SHA-256 is
joined to the digests of known licence texts and notices, made by the same expressions.

Known texts are there with and without heading, list numbers and appendix.  A copyright
line has a year, a sign or a holder after the word; what the licence itself says about
"copyright notice" or "copyright holders" at the start of a wrapped line is text.

Spellings are unified last, and only where the length and the first characters allow a
match: no replacement more than doubles or halves a word, so anything longer than twice
the longest known text cannot be one.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import saved, table

# Licence texts as published, without their copyright lines.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Names that notices use; a notice is a lead and a name.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "MIT": ["MIT License"], "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "AGPL-3.0": ["GNU Affero General Public License, version 3"], "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "CC0-1.0": ["CC0 1.0"],
}
LEADS = ["Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "This work is licensed under {}", "This software is licensed under {}", "This project is licensed under {}"]
#: Equivalent spellings, as words: the first is written as the second.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("centre", "center"), ("merchantibility", "merchantability"), ("analogue", "analog"), ("labour", "labor"),
]

#: Longer texts, as files, by licence.
LONG_TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Headings that published files of the short texts have.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "(MIT License)", "(The MIT License)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "BSD Zero-Clause License (0BSD)", "Zero-Clause BSD License", "Zero-Clause BSD (0BSD)", "0BSD"],
    "BSD-2-Clause": [f"{the}{name}" for the in ("", "The ") for name in ("BSD 2-Clause License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License")],
    "BSD-3-Clause": [f"{the}{name}" for the in ("", "The ") for name in ("BSD 3-Clause License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License")],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
#: Other wordings that are in use: (licence, published, other).
WORDINGS = [
    ("MIT", "this permission notice shall", "this permission notice (including the next paragraph) shall"), ("ISC", "and/or distribute", "and distribute"), ("0BSD", "and/or distribute", "and distribute"),
    ("BSD-2-Clause", "SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT OWNER OR"), ("BSD-3-Clause", "SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT OWNER OR"),
]
#: What ends the terms; an appendix that says how to apply them may be missing.
_ENDS = "END OF TERMS AND CONDITIONS"
#: Characters of a canonical text by which all others are ruled out first.
_PREFIX = 12

# After the word or sign: words of the licence itself, or else a sign, a year or a holder.
_OWN_WORDS = r"(?![^\p{L}\p{N}\n]*(?:notices?|holders?|owners?|owned|and|or|licen[cs]es?|laws?|in|of|to|is|are|statements?|interests?|rights?|disclaimers?|permissions?|protections?|treaty|treaties|doctrines?|infringements?|terms?|material|works?|conditions?|applies)\b)"
_COPYRIGHT = rf"(^|\n)[^\p{{L}}\p{{N}}\n]*(?:copyright(?=[^\p{{L}}\n]){_OWN_WORDS}[^\n]*[\p{{L}}\p{{N}}]|©|\(c\)(?=[^\p{{L}}\n]*(?:copyright|[12][0-9]{{3}}\b)))[^\n]*"
#: The same with up to two more lines of holders, if an empty line follows.
_COPYRIGHT_BLOCK = rf"{_COPYRIGHT}(?:\n[^\n]*[^\s][^\n]*){{1,2}}(?=\n[^\S\n]*(?:\n|$))"
_PUNCT = r"[^\p{L}\p{N}\n]+"


def without_marks(text: Column, copyright: str = _COPYRIGHT) -> Column:
    """Lower case, copyright lines emptied, punctuation as single spaces; line breaks stay."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), copyright, "$1")
    return F.regexp_replace(bare, _PUNCT, " ")


def respelled(text: Column) -> Column:
    """One line of text with equivalent spellings unified; ``text`` has single spaces."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(F.replace(out, F.lit(f" {a} "), F.lit(f" {b} ")), F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def whole_text(bare: Column) -> Column:
    """The document on one line, without lines that only reserve all rights."""
    return one_line(F.regexp_replace(bare, r"(^|\n) *all rights reserved *(?=\n|$)", "$1"))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every form that counts as the whole text."""
    out = []
    for name, body in TEXTS.items():
        bodies = [body] + [body.replace(a, b) for k, a, b in WORDINGS if k == name]
        plain = [re.sub(r"(?m)^[123]\. ", "", b) for b in bodies]
        lettered = [re.sub(r"(?m)^([123])\. ", lambda m: "abc"[int(m[1]) - 1] + ". ", b) for b in bodies]
        out += [(name, f"{head}\n{b}") for b in dict.fromkeys(bodies + plain + lettered) for head in ["", *HEADINGS[name]]]
    for name, body in LONG_TEXTS.items():
        end = body.find(_ENDS) + len(_ENDS)
        out += [(name, body)] + ([(name, body[:end]), (name, body[: end - len(_ENDS)])] if end >= len(_ENDS) else [])
    return out


def known_digests(spark: SparkSession) -> DataFrame:
    """kind ('text' or 'notice'), license, digest, length, prefix; a few hundred rows, fixed here."""
    rows = [("text", k, v) for k, v in known_texts()]
    articles = lambda name: [name] if name.startswith("CC") else [name, f"the {name}"]
    rows += [("notice", k, lead.format(x)) for k, names in NAMES.items() for name in names for x in articles(name) for lead in LEADS]
    rows += [("notice", k, f"SPDX-License-Identifier: {k}") for k in NAMES]
    known = spark.createDataFrame(rows, "kind string, license string, body string")
    bare = without_marks(F.col("body"))
    line = respelled(F.when(F.col("kind") == "text", whole_text(bare)).otherwise(one_line(bare)))
    known = known.select("kind", "license", F.sha2(line, 256).alias("digest"), F.length(line).alias("length"), F.substring(line, 1, _PREFIX).alias("prefix"))
    return saved(known.dropDuplicates(["kind", "digest"]))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_license, n_notice_lines, notices.

    text_license is the licence whose whole text the document is, or null.
    n_notice_lines counts the lines that are a known notice, notices has their licences,
    sorted and comma-joined, or is empty.

    Null and empty texts match nothing.  Rows that repeat are scanned each.  Headings,
    wrapping, list numbers, copyright lines and punctuation do not matter; a text with any other word more or less is not
    that licence.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    known = known_digests(spark)
    limits = {r["kind"]: r for r in known.groupBy("kind").agg((2 * F.max("length") + 64).alias("longest"), F.min("length").alias("shortest"), F.collect_set("prefix").alias("prefixes")).collect()}  # two rows
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Two readings: with the copyright lines gone, and with the lines of holders below them gone too.
    block = F.when(F.lower("text").rlike("copyright|©"), whole_text(without_marks(F.col("text"), _COPYRIGHT_BLOCK)))
    bare = named.select("doc_id", without_marks(F.col("text")).alias("bare"), block.alias("block"))
    lines = F.filter(F.transform(F.split("bare", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) <= limits["notice"]["longest"]))
    lines = F.filter(lines, lambda x: x.contains("licen") | x.contains("under"))  # every known notice has one of them
    digest = lambda x: F.when(
        F.length(x).between(limits["text"]["shortest"] // 2, limits["text"]["longest"]) & F.substring(respelled(F.substring(x, 1, 4 * _PREFIX)), 1, _PREFIX).isin(limits["text"]["prefixes"]),
        F.sha2(respelled(x), 256),
    )
    bare = bare.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text(F.col("bare")).alias("whole"), "block", lines.alias("lines"))
    rows = saved(bare.select("row", "doc_id", F.array_compact(F.array_distinct(F.array(digest(F.col("whole")), digest(F.col("block"))))).alias("digests"), "lines"))
    texts, notices = (F.broadcast(known.where(F.col("kind") == k).select("license", "digest")) for k in ("text", "notice"))
    found = rows.select("row", F.explode("lines").alias("line")).select("row", F.sha2(respelled("line"), 256).alias("digest")).join(notices, "digest")
    found = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("notices"))
    hit = rows.select("row", F.explode("digests").alias("digest")).join(texts, "digest").groupBy("row").agg(F.min("license").alias("license"))
    out = rows.select("row", "doc_id").join(hit, "row", "left").join(found, "row", "left")
    return out.select("doc_id", F.col("license").alias("text_license"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"), F.coalesce("notices", F.lit("")).alias("notices"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence texts and notices in whole ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
