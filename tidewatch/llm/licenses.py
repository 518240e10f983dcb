"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines and list marks gone, punctuation and space as single blanks, equivalent
spellings as one, a version as its number alone ('version 2.0', 'v2' and '2.0' are '2', '2.0+' is '2 or later'). Known licence texts pass through the same form. The digest of the whole text, and of each of its lines, is joined to
the known digests, so a licence is found as a whole document and as a notice line within one. So are notices that are wrapped over two or three lines, paragraphs, the text after an
introduction of one line or paragraph, and each identifier of an SPDX expression (`MIT OR Apache-2.0`, `GPL-2.0-only WITH Classpath-exception-2.0`, deprecated forms such as `GPL-2.0+`).

Every known text holds one of a few stems (ANCHORS), so a text or line without any can't be one and isn't brought to its form. Where a table of licences
has a text without one, all lines are.

Defined cases: a null or empty text matches nothing; a text whose canonical form is empty has no digest; repeated rows and rows with a null doc_id
are judged one by one; other columns are ignored. Two licences with one canonical form are both reported.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SPDX identifiers and the names that notices use.
NAMES = {
    "Apache-2.0": "Apache License, Version 2.0",
    "MIT": "MIT License",
    "ISC": "ISC License",
    "0BSD": "Zero-Clause BSD License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "GPL-2.0-only": "GNU General Public License, version 2",
    "GPL-3.0-only": "GNU General Public License, version 3",
    "LGPL-2.1-only": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-only": "GNU Lesser General Public License, version 3",
    "AGPL-3.0-only": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "Unlicense": "Unlicense",
    "CC0-1.0": "CC0 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}
#: Further names that notices and titles use. Punctuation, case and the form of the version don't matter.
OTHER_NAMES = {
    "Apache-2.0": ("Apache 2.0 License", "Apache Software License 2.0"),
    "MIT": ("MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License (ISC)",),
    "0BSD": ("BSD Zero-Clause License", "BSD 0-Clause License"),
    "BSD-2-Clause": ("2-Clause BSD License", "BSD 2-Clause Simplified License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("3-Clause BSD License", "BSD 3-Clause New or Revised License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "GPL-2.0-only": ("GNU General Public License v2.0 only", "GNU GPL v2", "GNU GPLv2", "GPL-2.0", "GPLv2"),
    "GPL-3.0-only": ("GNU General Public License v3.0 only", "GNU GPL v3", "GNU GPLv3", "GPL-3.0", "GPLv3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1 only", "GNU LGPL v2.1", "GNU LGPLv2.1", "LGPL-2.1", "LGPLv2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0 only", "GNU LGPL v3", "GNU LGPLv3", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0 only", "GNU AGPL v3", "GNU AGPLv3", "AGPL-3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0 (MPL-2.0)",),
    "EPL-2.0": ("Eclipse Public License 2.0 (EPL-2.0)",),
    "Unlicense": ("Unlicense License", "Unlicense (Public Domain)"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal"),
    **{
        f"CC-{short}-4.0": (f"Attribution{long} 4.0 International", f"Creative Commons Attribution{long} 4.0 International", f"Creative Commons Attribution{long} 4.0 International License", f"Creative Commons Attribution{long} 4.0 International Public License")
        for short, long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"))
    },
}
#: Identifiers that allow later versions, and the names that notices use for them.
OR_LATER = {
    "GPL-2.0-or-later": ("GNU General Public License v2.0 or later", "GNU General Public License, version 2 or later", "GPL-2.0+", "GPLv2+", "GPLv2 or later"),
    "GPL-3.0-or-later": ("GNU General Public License v3.0 or later", "GNU General Public License, version 3 or later", "GPL-3.0+", "GPLv3+", "GPLv3 or later"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License v2.1 or later", "GNU Lesser General Public License, version 2.1 or later", "LGPL-2.1+", "LGPLv2.1+"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License v3.0 or later", "GNU Lesser General Public License, version 3 or later", "LGPL-3.0+", "LGPLv3+"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License v3.0 or later", "GNU Affero General Public License, version 3 or later", "AGPL-3.0+", "AGPLv3+"),
}
#: The sentences around a licence's name.
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This project is licensed under {}.", 'Licensed under the {} (the "License");')
#: The header that the GNU licences ask for: subject, name of the licence, identifier and versions, and how the version is given.
GNU_HEADER = "{subject} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}"
GNU_SUBJECTS = ("This program", "This library", "This software", "This file", "It")
GNU_NAMES = {"GPL": ("GNU General Public License", ("2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("3.0",))}
GNU_VERSIONS = {"or-later": ("; either version {} of the License, or (at your option) any later version.", ", either version {} of the License, or any later version."), "only": ("; version {} of the License.", ", version {}.", "; version {} of the License only.", "; either version {} of the License.")}
#: Deprecated SPDX identifiers that have no + form of their own.
DEPRECATED = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0+": "AGPL-3.0-or-later"}
#: Whole texts of short licences.
TEXTS = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: One file for each further whole text: title, terms and appendix, with lines of %% between them.
FOLDER = Path(__file__).parent / "license_texts"
#: Equivalent spellings, as whole words of the canonical form.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "non infringement": "noninfringement", "ver": "version", "v": "version", "acknowledgement": "acknowledgment", "favour": "favor", "honour": "honor", "organisation": "organization", "redistributions": "redistribution", "whilst": "while", "wilful": "willful", "http": "https"}
#: Not those lines of a licence's terms that begin with the word because the text is wrapped there.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright(?!ed\b|able\b|s?[ \t]+(notice|holder|owner|license|licence|law|statement|interest|disclaimer|treaty|protection|and|or|on|resulting)s?\b)|\(c\)(?![ \t]+you\b)|©|all rights reserved)[^\n]*"
MARKS = r"(^|\n)[ \t]*([0-9]{1,2}[.)]|[-*•#/;])+[ \t]+"


def canonical(text: Column) -> Column:
    """The canonical form, line by line: lines are kept apart by \\n and empty ones are gone."""
    out = F.lower(text)
    for pattern, to in ((COPYRIGHT_LINE, "$1"), (MARKS, "$1"), (r"(?<=[0-9])\+(?![0-9])", " or later"), (r"\b(version\s*|ver\.?[ \t]*|v\.?[ \t]*)(?=[0-9])", ""), (r"(?<=[0-9])(\.0)+(?![0-9]|\.[0-9])", ""), (r"[^\p{L}\p{N}\n]+", " "), (r" ?\n[ \n]*", " \n "), (r"^[ \n]+|[ \n]+$", "")):
        out = F.regexp_replace(out, pattern, to)
    # each word gets its own blanks on both sides, so that neighbours don't share one
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.replace(out, F.lit("  "), F.lit(" "))


#: Stems of which each built-in text, in any spelling, holds one; `licen` also stands in licence.
ANCHORS = ("licen", "spdx", "releas", "distribut")


def anchored(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(or_, (F.contains(lowered, F.lit(a)) for a in ANCHORS))


def whole_texts() -> dict[str, tuple[str, str, str]]:
    """Title, terms and appendix of each licence that is known by its whole text; title and appendix may be empty."""
    out = {k: ("", text.removeprefix("MIT License\n\n"), "") for k, text in TEXTS.items()}
    for file in sorted(FOLDER.glob("*.txt")):
        title, terms, appendix = file.read_text(encoding="utf-8").split("%%\n")
        out[file.stem] = title, terms, appendix
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and text of the built-in notices and texts: each notice with each name, each text with and without titles and appendix."""
    names = {k: (name, k, f"{k} License", *OTHER_NAMES.get(k, ())) for k, name in NAMES.items()}
    later = {k: (k, *own) for k, own in OR_LATER.items()}
    named = spark.createDataFrame([(k, x) for k, own in (names | later).items() for x in own], "license_id string, name string")
    notices = named.select("license_id", F.explode(F.array(*(F.replace(F.lit(n), F.lit("{}"), F.col("name")) for n in NOTICES))).alias("text"))
    tags = spark.createDataFrame([(k, f"SPDX-License-Identifier: {k}") for k in (*NAMES, *OR_LATER)], "license_id string, text string")
    tags = tags.union(spark.createDataFrame([(to, f"SPDX-License-Identifier: {k}") for k, to in DEPRECATED.items()], tags.schema))
    headers = [(f"{family}-{v}-{kind}", GNU_HEADER.format(subject=subject, name=name, version=form.format(v.removesuffix(".0")))) for family, (name, versions) in GNU_NAMES.items() for v in versions for kind, forms in GNU_VERSIONS.items() for form in forms for subject in GNU_SUBJECTS]
    tags = tags.union(spark.createDataFrame(headers, tags.schema))
    rows = []
    for k, (title, terms, appendix) in whole_texts().items():
        usual = (x for n in names[k] for x in (n, f"The {n}")) if len(terms) < 5_000 else (title.strip().split("\n\n")[0], NAMES[k], *OTHER_NAMES.get(k, ())[:2])
        rows.append((k, sorted({"", title, *usual}), terms, sorted({"", appendix})))
    parts = spark.createDataFrame(rows, "license_id string, titles array<string>, terms string, appendices array<string>").withColumn("title", F.explode("titles")).withColumn("appendix", F.explode("appendices"))
    return notices.union(tags).union(parts.select("license_id", F.concat_ws("\n", "title", "terms", "appendix")))


def _digest(canon: Column) -> Column:
    flat = F.trim(F.regexp_replace(canon, r"[ \n]+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(.*)"
_OPERATORS = r"(?i)[ \t]+(?:OR|AND)[ \t]+|[()]+"
_EXCEPTION = r"(?i)[ \t]+WITH[ \t]+[^ \t]+"
#: A line that holds comment marks at most parts paragraphs.
_PARAGRAPH = r"\n[ \t]*[-*#/;]*[ \t]*\n"
WHOLE, LINE, RUN, PART, REST = range(5)


def _units(rows: DataFrame, may_hold) -> DataFrame:
    """doc_id, row and the units of each text that may be a licence: (kind, at, line). A text that can't hold one has none."""
    unit = lambda kind, at, line: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), line.alias("line"))
    none = F.array().cast("array<struct<kind:int,at:int,line:string>>")
    held = lambda units: F.filter(units, lambda u: may_hold(u["line"]))
    lined = rows.withColumn("lines", F.when(may_hold(F.col("text")), F.split("text", "\n")))
    n = F.size("lines")
    run = lambda w: F.when(n >= w, held(F.transform(F.slice("lines", 1, n - (w - 1)), lambda x, i: unit(RUN, i, F.array_join(F.slice("lines", i + 1, w), "\n"))))).otherwise(none)
    singles = lined.withColumn("singles", held(F.transform("lines", lambda x, i: unit(LINE, i, x))))
    tagged = F.filter("singles", lambda u: F.contains(F.lower(u["line"]), F.lit("spdx-license-identifier:")))
    parts = F.flatten(F.transform(tagged, lambda u: F.transform(F.split(F.regexp_extract(u["line"], _SPDX, 1), _OPERATORS), lambda x: unit(PART, u["at"], F.concat(F.lit("SPDX-License-Identifier: "), F.regexp_replace(x, _EXCEPTION, ""))))))
    paragraphs = F.filter(F.transform(F.split("text", _PARAGRAPH), lambda x, i: unit(RUN, i, x)), lambda u: F.contains(u["line"], F.lit("\n")) & may_hold(u["line"]))
    rests = F.filter(F.array(*(unit(REST, F.lit(k), F.regexp_replace("text", pattern, "")) for k, pattern in enumerate((r"\A[^\n]*\n", r"(?s)\A.*?\n[ \t]*\n")))), lambda u: (u["line"] != F.col("text")) & may_hold(u["line"]))
    whole = F.array(unit(WHOLE, F.lit(0), F.col("text")))
    return singles.withColumn("unit", F.explode_outer(F.when(F.col("lines").isNotNull(), F.concat(whole, "singles", parts, run(2), run(3), paragraphs, rests)))).select("doc_id", "row", "unit.kind", "unit.at", "unit.line")


def scan(documents: DataFrame, licenses: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 20_000) -> DataFrame:
    """One row for each document: whole_license (of the entire text), licenses (sorted, of the text or any unit of it, comma-joined) and n_lines (lines that match by themselves or in part).

    The digests are broadcast while there are at most `broadcast_rows` licences (about 100 bytes each); a larger table joins by shuffled digest.
    """
    if licenses is None:
        licenses = known_licenses(documents.sparkSession)
    canon = licenses.select("license_id", canonical(F.col("text")).alias("canon"))
    size = canon.agg(F.count("*").alias("rows"), F.coalesce(F.bool_and(anchored(F.col("canon")) | (F.trim("canon") == "")), F.lit(True)).alias("all_anchored")).first()
    known = canon.select("license_id", _digest(F.col("canon")).alias("digest")).where("digest IS NOT NULL").groupBy("digest").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    if size.rows <= broadcast_rows:
        known = F.broadcast(known)
    may_hold = anchored if size.all_anchored else (lambda text: text.isNotNull())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    units = _units(documents.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text")), may_hold)
    kind = F.col("kind")
    looked = units.select("doc_id", "row", "kind", "at", _digest(canonical(F.col("line"))).alias("digest")).join(known, "digest", "left").where(kind.isNull() | (kind == WHOLE) | F.col("ids").isNotNull())
    in_line = kind.isin(LINE, PART) & F.col("ids").isNotNull()
    of = lambda *kinds: F.flatten(F.collect_list(F.when(kind.isin(*kinds), F.col("ids"))))
    # what wrapped notices say counts where no licence text is found: such a text may quote one
    texts, runs = of(WHOLE, REST), of(RUN)
    found = looked.groupBy("row", "doc_id").agg(F.array_sort(F.array_distinct(F.concat(texts, of(LINE, PART), F.when(F.size(texts) == 0, runs).otherwise(F.array().cast("array<string>"))))).alias("ids"), F.max(F.when(kind == WHOLE, F.array_join("ids", ","))).alias("whole_license"), F.size(F.collect_set(F.when(in_line, F.col("at")))).alias("n_lines"))
    return found.select("doc_id", F.coalesce("whole_license", F.lit("")).alias("whole_license"), F.array_join("ids", ",").alias("licenses"), F.col("n_lines").cast("long").alias("n_lines"))
