"""The licence scan against a plain twin of the canonical form and of the units, and the notices that it must find."""

import hashlib
import random

import regex

from tidewatch.llm import licenses
from tidewatch.llm.queries import op1_license_scan


def plain_canonical(text):
    """The canonical form with one blank on both sides of each word, as plain Python."""
    out = text.lower()
    for pattern, to in ((licenses.COPYRIGHT_LINE, r"\1"), (licenses.MARKS, r"\1")):
        out = regex.sub(pattern, to, out)
    out = regex.sub(r"(?<=[0-9])\+(?![0-9])", " or later", out)
    out = regex.sub(r"\b(version\s*|ver\.?[ \t]*|v\.?[ \t]*)(?=[0-9])", "", out)
    out = regex.sub(r"(?<=[0-9])(\.0)+(?![0-9]|\.[0-9])", "", out)
    words = [w for w in regex.split(r"[^\p{L}\p{N}\n]+|\n", out) if w]
    for old, new in licenses.SPELLINGS.items():
        old, k, made = old.split(), 0, []
        while k < len(words):
            if words[k : k + len(old)] == old:
                made += new.split()
                k += len(old)
            else:
                made.append(words[k])
                k += 1
        words = made
    return " ".join(words)


def plain_units(text):
    lines = text.split("\n")
    yield "whole", text
    for line in lines:
        yield "line", line
        if m := regex.search(r"(?i)SPDX-License-Identifier:[ \t]*(.*)", line):
            for part in regex.split(r"(?i)[ \t]+(?:OR|AND)[ \t]+|[()]+", m.group(1)):
                yield "part", "SPDX-License-Identifier: " + regex.sub(r"(?i)[ \t]+WITH[ \t]+[^ \t]+", "", part)
    for w in (2, 3):
        for k in range(len(lines) - w + 1):
            yield "run", "\n".join(lines[k : k + w])
    for paragraph in regex.split(r"\n[ \t]*[-*#/;]*[ \t]*\n", text):
        yield "run", paragraph
    yield "rest", text.partition("\n")[2]
    yield "rest", regex.sub(r"(?s)\A.*?\n[ \t]*\n", "", text)


def digest(text):
    return hashlib.sha256(plain_canonical(text).encode()).hexdigest()


def plain_scan(spark, rows):
    known = {}
    for r in licenses.known_licenses(spark).collect():
        if plain_canonical(r.text):
            known.setdefault(digest(r.text), set()).add(r.license_id)
    out = []
    for doc_id, text in rows:
        ids, runs, whole, is_text = set(), set(), "", False
        if any(a in (text or "").lower() for a in licenses.ANCHORS):
            for kind, unit in plain_units(text):
                found = known.get(digest(unit), set()) if plain_canonical(unit) else set()
                is_text |= bool(found) and kind in ("whole", "rest")
                if kind == "run":
                    runs |= found
                else:
                    ids |= found
                whole = ",".join(sorted(found)) if kind == "whole" else whole
            ids |= set() if is_text else runs
        out.append((doc_id, whole, ",".join(sorted(ids))))
    return sorted(out, key=str)


def scanned(spark, rows):
    return sorted(((r.doc_id, r.whole_license, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"


def test_notices(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + licenses.whole_texts()["MIT"][1]
    cases = {
        "/*\n * Name of the program\n *\n" + "".join(f" * {line}\n" for line in GPL.splitlines()) + " *\n * This program is distributed in the hope\n */": "GPL-2.0-or-later",
        GPL.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1") + "\nMore text.": "LGPL-2.1-or-later",
        GPL.replace("; either version 2 of the License, or\n(at your option) any later version.", ", version 3."): "GPL-3.0-only",
        "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode": "Apache-2.0,MIT",
        "# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause)": "BSD-3-Clause,GPL-2.0-only",
        "/* SPDX-License-Identifier: GPL-2.0 */": "GPL-2.0-only", "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1-or-later", "SPDX-License-Identifier: NoSuch-1.0 OR MIT": "MIT",
        "Here is the licence of this work:\n" + mit: "MIT", "An introduction\nof two lines.\n\n" + mit: "MIT",
        "Text.\nLicensed under the Apache License,\nVersion 2.0.\nText.": "Apache-2.0", "This project is\nlicensed under the\nMIT License.": "MIT", "This project is\n\nlicensed under the\n\nweather.": "",
    }
    rows = list(enumerate(cases))
    got = {d: ids for d, _, ids in scanned(spark, rows)}
    assert [got[d] for d, _ in rows] == list(cases.values())


def test_scan_equals_a_plain_twin(spark):
    r = random.Random(4)
    texts = [row.text for row in licenses.known_licenses(spark).collect() if len(row.text) < 3000]
    pool = ["A plain line.", "", "released to the public", "Copyright (c) 2020 X", " * ", "licence", "the licensed distribution", "v2.0+ licenses"]
    rows = []
    for k in range(150):
        own = [r.choice(pool) for _ in range(r.randint(0, 4))] + [r.choice(texts)] + [r.choice(pool) for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            own[r.randrange(len(own))] = r.choice(texts).replace(" ", "\n", 1)
        rows.append((k, "\n".join(own)))
    rows += [(200, None), (201, ""), (None, "Licensed under the MIT License."), (202, "licen")]
    got = scanned(spark, rows)
    assert got == plain_scan(spark, rows) and sum(bool(ids) for _, _, ids in got) > 100


def test_query_equals_a_plain_twin(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.whole_license, r.licenses) for r in op1_license_scan(spark, path).collect()), key=str) == plain_scan(spark, rows)


def test_long_text_and_clashing_columns(spark):
    text = "a released line\n" * 60_000 + "SPDX-License-Identifier: MIT"
    docs = spark.createDataFrame([(1, text, 1, "x", "y", 2, "z")], "doc_id long, text string, row int, unit string, line string, at int, ids string")
    assert [(r.doc_id, r.licenses, r.n_lines) for r in licenses.scan(docs).collect()] == [(1, "MIT", 1)]
