import os

import pytest

from quire.llm import license_scan
from tests.test_queries import DATA

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-Rights-Reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def scan(text):
    scanner = license_scan.Scanner()
    return [m[0] for m in scanner.matches(scanner.sentences(text))]


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    for text in (line, f"some words\n{line}\nmore words", f"End of it. {line} Begin", line.upper(), f"a\n\n{line.replace(' ', chr(10), 2)}\nb"):
        assert scan(text) == [LINES[line]], text
    assert scan(f"not {line}") == [] and scan(line[:-6]) == []


def test_whole_licence_is_one_match():
    assert scan(MIT) == ["MIT"]
    assert scan(MIT.replace("a copy\nof", "a copy of").replace("rights\nto", "rights to")) == ["MIT"]
    begin, end = [m[1:] for m in license_scan.Scanner().matches(license_scan.Scanner().sentences("x\n" + MIT))][0]
    assert ("x\n" + MIT)[begin:end].startswith("MIT License") and ("x\n" + MIT)[begin:end].endswith("Software")


GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{then} either version {version} of the License, or
(at your option) any later version.
"""
PUBLISHED = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"),
    (GPL.format(mark=":", then=",", version=3), "GPL-3.0"), (GPL.format(mark=";", then=";", version=2), "GPL-2.0"), (GPL.format(mark=";", then=",", version=2), "GPL-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n', "Apache-2.0"),
]


@pytest.mark.parametrize("notice, licence", PUBLISHED)
def test_published_notices(notice, licence):
    assert scan(notice) == scan(f"Some words.\n{notice}\nmore: words") == [licence]


@pytest.mark.parametrize("mark", ["\n", ": ", "; "])
def test_every_sentence_over_inner_marks(mark):
    scanner = license_scan.Scanner()
    for sentence, identifier in scanner.known.items():
        assert identifier in [f.identifier for f in scanner.sentences(sentence.replace(" ", mark, 2))], sentence


def test_rules_in_order_and_gaps():
    rules = (("AB", ("a", "b")), ("A", ("a",)), ("B", ("b",)))
    scanner = license_scan.Scanner({"one": "a", "two": "b"}, rules, gap=1)
    run = lambda t: [m[0] for m in scanner.matches(scanner.sentences(t))]
    assert run("One. Two.") == ["AB"] and run("One. x. Two.") == ["AB"] and run("One. x. y. Two.") == ["A", "B"] and run("Two. One. ") == ["B", "A"]
    assert run("One. One. Two. Two.") == ["AB", "AB"]


def test_scan(spark, awkward, documents):
    df = awkward.unionByName(documents([(20, "a. All rights reserved. " * 3), (21, "x " * 200_000 + "\nAll rights reserved.")]))
    rows = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in license_scan.scan_licenses(df).collect()}
    assert rows[20] == ["All-Rights-Reserved"] * 3 and rows[21] == ["All-Rights-Reserved"] and rows[1] == rows[2] == rows[4] == []
    assert license_scan.scan_licenses(df).count() == df.count()
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_against_whole_lines(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    want = {r["doc_id"]: ",".join(dict.fromkeys(LINES[x] for x in r["text"].split("\n") if x in LINES)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["licenses"] for r in license_scan.op4_license_scan(spark, folder).collect()}
    assert got == want and any(want.values())
