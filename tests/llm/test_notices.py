"""License notices that follow each other."""

import random

import numpy as np

from histomesh.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)


def found(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    words = licenses.word_ids(raw, np.array([0, len(raw)]))[0]
    return [(INDEX.names[m[0]], m[3], m[4]) for m in sorted(licenses.notices(INDEX, words, 0.8), key=lambda m: m[3])]


def test_every_repeated_notice_is_found():
    assert found("Released under the MIT License. " * 2) == [("MIT", 0, 5), ("MIT", 5, 10)]
    assert found("Licensed under CC BY 4.0. " * 4) == [("CC-BY-4.0", 6 * k, 6 * k + 6) for k in range(4)]


def test_rows_of_notices_equal_how_they_were_made():
    r = random.Random(2)
    texts = [(name, text) for name, of in licenses.TEMPLATES.items() for text in of]
    for _ in range(150):
        made, want, at = [], [], 0
        for name, text in r.choices(r.sample(texts, 2), k=r.randint(1, 8)):
            n = len(INDEX.words[[t for _, t in texts].index(text)])
            for _ in range(r.choice([0, 0, 1, 3])):
                made.append(f"filler{r.randrange(10**6)}")
                at += 1
            made.append(text)
            want.append((name, at, at + n))
            at += n
        assert found(" ".join(made)) == want


def test_repeats_of_one_notice_in_rows(spark):
    rows = [(1, "Released under the MIT License.\n" * 3), (2, "x")]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(rows[0][1][r["start"] : r["end"]] for r in got) == ["Released under the MIT License"] * 3


def test_relatives_of_a_license_are_not_taken_for_it():
    """Names and versions must agree: a relative is named rightly or not at all."""
    gnu = "under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    header = "This program is free software{} you can redistribute it and/or modify it "
    cases = {
        "Licensed under the Acme License.": [],
        "Licensed under the Zlib License.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under CC BY 3.0.": [],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "This work is licensed under the GNU GPL, version 1.": [],
        "Released under the ISC License.": ["ISC"],
        header.format(";") + gnu.format("", ";", 2): ["GPL-2.0"],
        header.format(":") + gnu.format("", ",", 3): ["GPL-3.0"],
        header.format(":") + gnu.format("Affero ", ",", 3): ["AGPL-3.0"],
        header.format(":") + gnu.format("Lesser ", ",", 3): [],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": ["BSD-2-Clause OR BSD-3-Clause"],
        "Licensed under the BSD 2-Clause License.": ["BSD-2-Clause"],
        "Licensed under the BSD 4-Clause License.": [],
    }
    assert {text: [name for name, *_ in found(text)] for text in cases} == cases


def test_own_templates_need_no_phrases_unless_given(spark):
    docs = spark.createDataFrame([(1, "used with leave of the Blue Guild today")], "doc_id long, text string")
    own = {"Guild": ("used with leave of the Red Guild today",)}
    assert licenses.find_licenses(docs, templates=own).count() == 1
    assert licenses.find_licenses(docs, templates=own, telling={"Guild": ("Red Guild",)}).count() == 0
