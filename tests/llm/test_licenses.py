"""Whole texts and spellings that the licence scan has to know."""

import textwrap

from tidewatch.llm import licenses


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.whole_license, r.licenses) for r in sorted(rows, key=lambda r: r.doc_id)]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def test_whole_texts_with_and_without_title(spark):
    whole = licenses.whole_texts()
    assert set(whole) >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "MIT", "ISC", "0BSD"}
    cases = [(k, text) for k, (title, terms, appendix) in whole.items() for text in (title + "\n" + terms + "\n" + appendix, terms, terms + "\n\n" + appendix, f"{licenses.NAMES[k]}\n\n{terms}")]
    assert found(spark, [text for _, text in cases]) == [(k, k) for k, _ in cases]


def test_wrapping_and_copyright_lines(spark):
    title = "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n"
    terms = licenses.whole_texts()["BSD-3-Clause"][1]
    texts = [title + wrapped(terms, w) for w in (50, 60, 66, 72, 79, 100, 2000)] + ["The MIT License (MIT)\n\nCopyright 2021 A. Person\n\n" + wrapped(licenses.whole_texts()["MIT"][1], 70)]
    assert found(spark, texts) == [("BSD-3-Clause", "BSD-3-Clause")] * 7 + [("MIT", "MIT")]


def test_version_spellings(spark):
    same = {
        "Apache-2.0": ["the Apache License 2.0", "the Apache License, Version 2.0", "the Apache License v2.0", "the Apache License v2", "the Apache License, version 2", "Apache-2.0", "the Apache 2.0 license"],
        "GPL-3.0-only": ["the GNU General Public License v3.0", "the GNU General Public License version 3", "the GPLv3", "the GPL v3", "GPL-3.0"],
        "CC-BY-SA-4.0": ["the Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA v4.0"],
    }
    other = ["the Apache License 1.0", "the Apache License 2.0.1", "the GPL v4"]
    cases = [(k, n) for k, names in same.items() for n in names] + [("", n) for n in other]
    assert found(spark, [f"Text.\nLicensed under {n}." for _, n in cases]) == [("", k) for k, _ in cases]


def test_neighbouring_spellings_have_one_form(spark):
    rows = spark.createDataFrame([("sub licence licence licence",), ("sub license license license",), ("licence sub licence",), ("license sublicense",)], "t string")
    forms = [r[0].split() for r in rows.select(licenses.canonical(rows.t)).collect()]
    assert forms[0] == forms[1] and forms[2] == forms[3]


def test_each_built_in_text_is_found_in_other_spellings(spark):
    from pyspark.sql import functions as F

    known = licenses.known_licenses(spark)
    shown = F.concat(F.lit("Copyright (c) 2021 A. Person\n  "), F.upper(F.replace(F.regexp_replace("text", r"\blicense\b", "licence"), F.lit(", "), F.lit(" ,\t "))))
    rows = known.select(F.row_number().over(licenses_order()).cast("long").alias("doc_id"), "license_id", shown.alias("text"))
    ids = {r.doc_id: r.license_id for r in rows.select("doc_id", "license_id").collect()}
    for r in licenses.scan(rows.select("doc_id", "text")).collect():
        assert ids[r.doc_id] in r.whole_license.split(","), (r.doc_id, ids[r.doc_id], r.whole_license)


def licenses_order():
    from pyspark.sql import Window

    return Window.orderBy("license_id", "text")


def test_notices_of_later_versions_and_of_the_usual_header(spark):
    texts = ["# SPDX-License-Identifier: GPL-3.0-or-later", 'x\nLicensed under the Apache License, Version 2.0 (the "License");\ny', "licensed under MIT", "Licensed under the GPLv2 or later.", "no notice", "Distributed for reading.\nReleased today."]
    assert [x[1] for x in found(spark, texts)] == ["GPL-3.0-or-later", "Apache-2.0", "MIT", "GPL-2.0-or-later", "", ""]


def test_defined_cases(spark):
    one = "Licensed under the MIT License."
    rows = [(1, one, "a", 1), (1, one, "a", 1), (None, one, "a", 1), (2, None, "a", 1), (3, "", "a", 1), (4, "© 2020", "a", 1), (5, "plain line\n" * 200_000 + one, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, row int")
    got = sorted(((r.doc_id, r.licenses, r.n_lines) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT", 1), (1, "MIT", 1), (None, "MIT", 1), (2, "", 0), (3, "", 0), (4, "", 0), (5, "MIT", 1)], key=str)
    assert licenses.scan(docs.where("false")).count() == 0
    own = spark.createDataFrame([("OWN", "Free for all uses"), ("EMPTY", "(c) 1999")], "license_id string, text string")
    assert {r.licenses for r in licenses.scan(spark.createDataFrame([(1, "free, for ALL uses!")], "doc_id long, text string"), own).collect()} == {"OWN"}
