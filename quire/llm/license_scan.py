"""Operator 4, licence scans by sentence rules.

A text is cut into sentences, at line ends and after marks. A sentence that runs
on over line ends, colons or semicolons is also tried as a whole, from each of its parts on. Sentences
are normalised (letters and digits in lower case) and looked up among known
licence sentences. The identifiers found, in order, are matched against ordered licence
rules: a rule is a sequence of identifiers that must follow one another with at most
``GAP`` other sentences between; earlier rules take their sentences first, each
sentence serves one rule. Whole texts are read in one narrow pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table, text_or_empty

#: Other sentences that may stand between two of a rule.
GAP = 3

# Licence sentences as they are normalised, with their identifiers; {a|b} stands for either.
SENTENCES = {
    "{this work is |this file is |this software is |this program is |}{licensed|released|distributed} under {the |}gnu general public license {version 3|v3|version 3 or later}": "gpl3-notice",
    "{this work is |this file is |this software is |this program is |}{licensed|released|distributed} under {the |}gnu general public license {version 2|v2|version 2 or later}": "gpl2-notice",
    "{this work is |this file is |this software is |this program is |}{licensed|released|distributed} under {the |}gnu lesser general public license {version 3|v3|version 2 1}": "lgpl-notice",
    "{this work is |this file is |this software is |this program is |}{licensed|released|distributed} under the mit license": "mit-notice",
    "{this work is |this file is |this software is |this program is |}{licensed|released|distributed} under the apache license {version 2 0|2 0}{| the license}": "apache2-notice",
    "{this work is |this file is |this software is |this program is |}{licensed|released|distributed} under the {bsd 3 clause|3 clause bsd|new bsd} license": "bsd3-notice",
    "{this work is |this file is |}{licensed|released} under {a |}{cc by nc|creative commons attribution noncommercial} 4 0{| international}{| license}": "ccbync4-notice",
    "{this work is |this file is |}{licensed|released} under {a |}{cc by sa|creative commons attribution sharealike} 4 0{| international}{| license}": "ccbysa4-notice",
    "{this work is |this file is |}{licensed|released} under {a |}{cc by|creative commons attribution} 4 0{| international}{| license}": "ccby4-notice",
    "{this work is |}{released into|dedicated to|in} the public domain": "public-domain",
    "all rights reserved": "rights-reserved",
    "spdx license identifier mit": "mit-notice",
    "spdx license identifier apache 2 0": "apache2-notice",
    "spdx license identifier gpl 3 0{| only| or later}": "gpl3-notice",
    "spdx license identifier gpl 2 0{| only| or later}": "gpl2-notice",
    "spdx license identifier bsd 3 clause": "bsd3-notice",
    "{mit license|the mit license mit|the mit license}": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
}
#: Ordered rules: licence, and the identifiers in order.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("rights-reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance")),
    ("GPL-3.0", ("gpl3-grant",)), ("GPL-2.0", ("gpl2-grant",)), ("GPL-3.0", ("gpl3-notice",)), ("GPL-2.0", ("gpl2-notice",)), ("LGPL", ("lgpl-notice",)),
    ("MIT", ("mit-notice",)), ("Apache-2.0", ("apache2-notice",)), ("BSD-3-Clause", ("bsd3-notice",)), ("CC-BY-NC-4.0", ("ccbync4-notice",)), ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)), ("Public-Domain", ("public-domain",)), ("All-Rights-Reserved", ("rights-reserved",)),
)

_WORD = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A sentence ends with a line, or after a mark before white space.
_END = re.compile(r"\n|[.!?:;]+(?=\s)")


def expand(pattern: str) -> list[str]:
    head, brace, rest = pattern.partition("{")
    if not brace:
        return [" ".join(pattern.split())]
    choices, _, tail = rest.partition("}")
    return [x for c in choices.split("|") for x in expand(head + c + tail)]


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    return {x: identifier for pattern, identifier in sentences.items() for x in expand(pattern)}


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.translate(_LOWER)))


@dataclass(frozen=True)
class Found:
    """A known sentence: the first and last of the text's lines and sentences that it consists of, its identifier and place."""

    number: int
    last: int
    identifier: str
    begin: int
    end: int


class Scanner:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=None, gap: int = GAP):
        self.known = known_sentences(sentences)
        # A longer rule that begins or ends with a shorter one must be tried before it.
        self.rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1]))
        self.gap = gap
        self.longest = max((len(x.split()) for x in self.known), default=0)

    def sentences(self, text: str) -> list[Found]:
        """Known sentences in order, of those that overlap the one that begins first and is longest."""
        found, open_, number, at = [], [], 0, 0  # open_: (normalised, begin, number) of parts that the sentence so far consists of
        ends = [(m.start(), m.end(), not m.group().strip("\n:;")) for m in _END.finditer(text)] + [(len(text), len(text), False)]
        for stop, after, inner in ends:
            own = normalise(text[at:stop]) if stop > at else ""
            if own:
                identifier, begin, first = self.known.get(own), at, number
                joined = own
                for before, start, n in reversed(open_):
                    joined = f"{before} {joined}"
                    if joined.count(" ") >= self.longest:
                        break
                    if whole := self.known.get(joined):
                        identifier, begin, first = whole, start, n
                if identifier:
                    while found and found[-1].last >= first:
                        found.pop()
                    found.append(Found(first, number, identifier, begin, stop))
                open_ = [*open_, (own, at, number)][-self.longest :] if inner else []
                number += 1
            elif not inner:
                open_ = []
            at = after
        return found

    def matches(self, found: list[Found]) -> list[tuple[str, int, int]]:
        """(licence, begin, end) in page order."""
        free, out = list(found), []
        for licence, wanted in self.rules:
            taken: set[int] = set()
            for start in range(len(free)):
                chain: list[int] = []
                i = start
                while i < len(free) and len(chain) < len(wanted):
                    if i not in taken:
                        if chain and free[i].number - free[chain[-1]].last > self.gap + 1:
                            break
                        if free[i].identifier == wanted[len(chain)]:
                            chain.append(i)
                    if not chain:
                        break
                    i += 1
                if len(chain) == len(wanted):
                    out.append((licence, free[chain[0]].begin, max(free[k].end for k in chain)))
                    taken.update(chain)
            if taken:
                free = [f for k, f in enumerate(free) if k not in taken]
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def scan_licenses(df: DataFrame, sentences: dict[str, str] = SENTENCES, rules=None, gap: int = GAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, identifiers (array of string), matches (array of struct(license, begin, end), code points).

    Null and empty texts have none. Repeated rows and null ids are kept, an empty
    table gives an empty result; other columns are not read.
    """
    own = df.select(text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        scanner = Scanner(sentences, rules, gap)
        for batch in batches:
            found = [scanner.sentences(x.as_py()) for x in batch.column(0)]
            matches = [[dict(zip(("license", "begin", "end"), m)) for m in scanner.matches(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([[x.identifier for x in f] for f in found], pa.list_(pa.string())), pa.array(matches, kind)], names=["doc_id", "identifiers", "matches"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, identifiers array<string>, matches array<struct<license:string,begin:bigint,end:bigint>>")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, licenses (each once in page order, joined by commas; empty if none), n_matches, identifiers."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_distinct(F.transform("matches", lambda m: m["license"]))
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("matches").cast("bigint").alias("n_matches"), F.array_join("identifiers", ",").alias("identifiers"))
