"""License scans against a plain reading of phrases, rules and suppression."""

import random
import re

from tessella.llm.licenses import BASE, LicenseRule, Scanner, default_rules, license_spans, op11_licenses, word_line

SF = "/root/testdata/sf0.001"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base(text):
    w, out = words(text), []
    for phrase, label in BASE.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return len(w), out


def plainly(scanner, text):
    """All rules without the prefilter, and suppression by comparing every two matches."""
    line, _ = word_line(text)
    found = scanner.matches(line, range(len(scanner.rules)))
    rule = scanner.rules.__getitem__

    def beaten(x, y):
        inside = y[1] <= x[1] and x[2] <= y[2] and x != y
        p, q = rule(x[0]).priority, rule(y[0]).priority
        return inside and (q > p or q == p and ((y[2] - y[1], -y[0]) > (x[2] - x[1], -x[0])))

    left = [x for x in found if rule(x[0]).kind == "base" or not any(beaten(x, y) for y in found)]
    return sorted((k, line.count(" ", 0, s) - 1, line.count(" ", 0, e)) for k, s, e in left)


PARTS = (
    "licensed under the GNU General Public License, version 3|the MIT License|under the MIT license.|CC BY-NC 4.0|CC-BY-NC-SA 4.0|Apache License, Version 2.0|apache license version 2 or later|SPDX-License-Identifier: GPL-2.0-or-later|"
    "SPDX-License-Identifier: MIT-0|https://www.gnu.org/licenses/lgpl-3.0.html|BSD 3-Clause License|Mozilla Public License Version 2.0|redistribution and use in source and binary forms, with or without modification, are permitted|"
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software|License: ISC license|the unlicense|Boost Software License 1.0|Creative Commons Attribution-ShareAlike 4.0 International License|"
    "Copyright (c) 2020 A. Nother. All rights reserved.|éa ñ|word|MIT|apache|license|version|2|under the|gnu"
).split("|")


def test_more_than_five_hundred_rules_with_true_keywords():
    rules = default_rules()
    assert len(rules) > 500 and sum(r.kind == "base" for r in rules) == len(BASE)
    assert all(re.fullmatch(r"[a-z0-9 ]+", r.keyword) for r in rules)


def test_scanner_against_all_rules():
    rng, scanner = random.Random(4), Scanner(default_rules())
    for _ in range(300):
        text = " ".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        n, got = scanner.scan(text)
        assert n == len(words(text)) and sorted(got) == plainly(scanner, text)


def test_names_are_told_apart():
    label = lambda t: {scanner.rules[k].label for k, _, _ in scanner.scan(t)[1]}
    scanner = Scanner(default_rules())
    assert label("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert label("GNU Lesser General Public License") == {"lgpl"}
    assert label("SPDX-License-Identifier: GPL-2.0-or-later") == {"gpl-2.0-or-later"}
    assert label("Creative Commons Attribution-NonCommercial 4.0 International License") == {"cc-by-nc"}
    assert label("MIT has a license to practise; apache helicopters; version 2") == set()


def test_query_against_plain_phrases(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, scanner = op11_licenses(spark, SF).collect(), Scanner(default_rules())
    assert len(got) == len(docs)
    for r in got:
        n, places = base(docs[r["doc_id"]])
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        left = plainly(scanner, docs[r["doc_id"]])
        assert r["labels"] == ",".join(sorted({scanner.rules[k].label for k, _, _ in left}))
        assert r["score"] == max((scanner.rules[k].confidence for k, _, _ in left), default=0.0)


def test_edges(spark):
    long = "x " * 300_000 + "Released under the MIT License. " * 2000
    texts = [None, "", "  \n ", "under the mit license", "under the mit license", "UNDER\tTHE-MIT_LICENSE", "under the mit license2", long]
    df = spark.createDataFrame([(k, t, "z", 7) for k, t in enumerate(texts)] + [(None, "cc by nc", "z", 7), (3, "under the mit license", "z", 7)], "doc_id long, text string, found string, n_words int")
    rows = license_spans(df).collect()
    count = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], sum(f["kind"] == "base" for f in r["found"])) for r in rows)
    assert count == sorted([(False, 0, 0, 0), (False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 4, 1), (False, 3, 4, 1), (False, 4, 4, 1), (False, 5, 4, 1), (False, 6, 4, 0), (False, 7, 310_000, 2000), (True, 0, 3, 1)])
    assert license_spans(df.limit(0)).count() == 0
    own = (LicenseRule("a", "b c", "a b c", "name"), LicenseRule("d", "b c", "b c", "grant"), LicenseRule("e", "b c", "b c", "name"))
    found = license_spans(spark.createDataFrame([(1, "A, b. C")], "doc_id long, text string"), own).first()["found"]
    assert [(f["label"], f["first"], f["after"]) for f in found] == [("a", 0, 3), ("d", 1, 3)]
