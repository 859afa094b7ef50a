from __future__ import annotations

from gridloom.llm import licenses


def test_scan(spark):
    mit = licenses.MIT_GRANT
    rows = [
        (1, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit), (2, mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace(" ", "\n ")),
        (3, "prose\n  released under the MIT Licence!\nmore"), (4, "It is released under the MIT License."), (5, None), (6, ""), (7, "\n\n...\n"),
        (8, "SPDX-License-Identifier: MIT\nLicensed under CC BY-NC 4.0.\n(c) me\nLicensed under CC BY-NC 4.0."), (9, "The MIT License (MIT)\n\n" + mit), (None, "Released under the MIT License."),
        (8, "x"), (10, "prose " * 100_000 + "\nReleased under the MIT License."), (11, "Copyright 2020 only"),
    ]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, license string")
    got = licenses.scan(docs, licenses.known_licenses(spark)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.license, r.notices) for r in got if r.license or r.notices} == {
        (1, "MIT", ""), (2, "MIT", ""), (3, None, "MIT"), (8, None, "CC-BY-NC-4.0,MIT"), (9, "MIT", ""), (None, "MIT", "MIT"), (10, None, "MIT"),
    }
    assert licenses.scan(docs.limit(0), licenses.known_licenses(spark)).collect() == []


def test_unknown_and_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "license string, text string")
    assert {tuple(r) for r in licenses.scan(docs, none).collect()} == {(1, None, ""), (2, None, "")}
    monkeypatch.setattr(licenses, "BROADCAST_KNOWN", 1)
    assert {tuple(r) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()} == {(1, "MIT", "MIT"), (2, None, "")}


def test_whole_texts(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense"]
    texts = [(licenses.TEXTS / f"{n}.txt").read_text() for n in names]
    texts = ["Copyright (c) 2021 Someone\n" + t.replace("\n", "\r\n  ") for t in texts]
    apache = texts[0][: texts[0].index("APPENDIX: How to apply")]
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2021, Someone\nAll rights reserved.\n\n" + (licenses.TEXTS / "BSD-3-Clause.txt").read_text().replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    docs = spark.createDataFrame(list(enumerate([*texts, apache, bsd, texts[0] + "\nand one more clause"])), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(got))] == [*names, "Apache-2.0", "BSD-3-Clause", None]
