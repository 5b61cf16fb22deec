"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its words (A-Z lower-cased, runs of letters, digits and non-ASCII characters)
joined by single spaces, so punctuation, markup and line breaks do not matter.  Every rule is
a regular expression over that line with a label, a priority and a keyword that each of its
matches holds.  One automaton finds the keywords in a single pass; only rules whose keyword
occurs are run, so almost all texts meet no expression at all.

Overlaps are resolved by priority and containment: a match that lies within a match of higher
priority, or within a longer one of equal priority, is suppressed (of equal intervals with
equal priority the earlier rule stays).  So "gnu general public license" goes where "licensed
under the gnu general public license version 3" stands.  Base phrases are rules of the highest
priority and are never suppressed.

``score`` is the highest confidence among a text's remaining matches, 0 where there are none.

Null text is empty: no words, no labels, score 0, null places.  Texts are scanned whole, in
time linear in their length; repeated rows count again; ties of equal intervals go to the
earlier rule; an empty table gives an empty table; columns other than the two named are not
read, so clashing names are safe.  Everything is map-only: no group, copy or source is
gathered anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that always count, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Names of licenses: label | keyword | expression.  Versions appear as words, so 2.0 is "2 0".
NAMES = r"""
mit | mit license | mit license
mit | mit x11 | mit x11 license
mit | x11 license | x11 license
mit-0 | mit no attribution | mit no attribution(?: license)?
mit-0 | mit 0 | mit 0 license
apache-2 | apache | apache(?: software)? license (?:version |v ?)?2(?: 0)?
apache-2 | asl 2 | asl 2 0
apache-1.1 | apache | apache(?: software)? license (?:version |v ?)?1 1
apache-1.0 | apache | apache(?: software)? license (?:version |v ?)?1 0
apache | apache | apache(?: software)? license
gpl-1.0 | general public license | (?:gnu )?general public license (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)1(?: 0)?
gpl-2.0 | general public license | (?:gnu )?general public license (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?
gpl-3.0 | general public license | (?:gnu )?general public license (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
gpl-2.0-or-later | general public license | (?:gnu )?general public license (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)? (?:of the license )?or (?:at your option )?(?:any later|later|newer)(?: version)?
gpl-3.0-or-later | general public license | (?:gnu )?general public license (?:gpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)? (?:of the license )?or (?:at your option )?(?:any later|later|newer)(?: version)?
gpl | general public license | gnu general public license
gpl-2.0 | gpl | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?
gpl | gnu gpl | gnu gpl
lgpl-2.0 | library general public license | (?:gnu )?library general public license(?: lgpl)?(?: as published by the free software foundation)?(?: either)?(?: (?:version |v ?)2(?: 0)?)?
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:lgpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)2 1
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:lgpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
lgpl | lesser general public license | (?:gnu )?lesser general public license
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?2 1
lgpl-3.0 | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?
lgpl | gnu lgpl | gnu lgpl
agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:agpl )?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
agpl-1.0 | affero general public license | affero general public license (?:version |v ?)1(?: 0)?
agpl | affero general public license | (?:gnu )?affero general public license
agpl-3.0 | agpl | (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?
agpl | gnu agpl | gnu agpl
gfdl-1.1 | free documentation license | (?:gnu )?free documentation license (?:version |v ?)1 1
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version |v ?)1 2
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version |v ?)1 3
gfdl | free documentation license | (?:gnu )?free documentation license
gfdl | gnu fdl | gnu fdl
bsd-2-clause | bsd | (?:2 clause|two clause|simplified|freebsd) bsd(?: license)?
bsd-2-clause | bsd | bsd (?:2 clause|two clause|2|simplified) license
bsd-3-clause | bsd | (?:3 clause|three clause|new|modified|revised) bsd(?: license)?
bsd-3-clause | bsd | bsd (?:3 clause|three clause|3|new|modified|revised) license
bsd-4-clause | bsd | (?:4 clause|four clause|original) bsd(?: license)?
bsd-4-clause | bsd | bsd (?:4 clause|four clause|original) license
bsd-0-clause | bsd | (?:0 clause|zero clause|0bsd|free public) bsd(?: license)?
bsd-0-clause | 0bsd | 0bsd
bsd | bsd | bsd (?:style )?licenses?
isc | isc license | isc license
zlib | zlib | zlib (?:libpng )?license
libpng | libpng | (?:libpng|png reference library) license
curl | curl license | curl license
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? license
postgresql | postgresql | postgresql license
python-2.0 | python | python(?: software foundation)? license(?: (?:version |v ?)?2(?: 0)?)?
ruby | ruby license | ruby license
php-3.01 | php license | php license(?: (?:version |v ?)?3 0?1)?
artistic-1.0 | artistic license | artistic license (?:version |v ?)?1(?: 0)?
artistic-2.0 | artistic license | artistic license (?:version |v ?)?2(?: 0)?
artistic | artistic license | artistic license
perl | same terms as perl | same terms as perl(?: itself)?
mpl-1.0 | mozilla public license | mozilla public license (?:version |v ?)?1 0
mpl-1.1 | mozilla public license | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | mozilla public license | mozilla public license (?:mpl )?(?:version |v ?)?2(?: 0)?
mpl | mozilla public license | mozilla public license
mpl-2.0 | mpl 2 | mpl 2 0
epl-1.0 | eclipse public license | eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 | eclipse public license | eclipse public license (?:version |v ?)?2(?: 0)?
epl | eclipse public license | eclipse public license
edl-1.0 | eclipse distribution license | eclipse distribution license(?: (?:version |v ?)?1(?: 0)?)?
cddl-1.0 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v ?)?1 0
cddl-1.1 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v ?)?1 1
cddl | common development and distribution license | common development and distribution license
cpl-1.0 | common public license | common public license(?: (?:version |v ?)?1(?: 0)?)?
cpal-1.0 | common public attribution license | common public attribution license(?: (?:version |v ?)?1(?: 0)?)?
ipl-1.0 | ibm public license | ibm public license(?: (?:version |v ?)?1(?: 0)?)?
eupl-1.1 | european union public licen | european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 1
eupl-1.2 | european union public licen | european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 2
eupl | european union public licen | european union public licen[cs]e
cecill-2.1 | cecill | cecill(?: free software)? license(?: agreement)?
osl-3.0 | open software license | open software license(?: (?:version |v ?)?3(?: 0)?)?
afl-3.0 | academic free license | academic free license(?: (?:version |v ?)?3(?: 0)?)?
ecl-2.0 | educational community license | educational community license(?: (?:version |v ?)?2(?: 0)?)?
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
bsl-1.0 | boost software license | boost software license(?: (?:version |v ?)?1(?: 0)?)?
busl-1.1 | business source license | business source license(?: (?:version |v ?)?1 1)?
sspl-1.0 | server side public license | server side public license(?: (?:version |v ?)?1(?: 0)?)?
elastic-2.0 | elastic license | elastic license(?: (?:version |v ?)?2(?: 0)?)?
commons-clause | commons clause | commons clause(?: license condition)?
unlicense | unlicense | (?:the )?unlicense(?: org)?
wtfpl | wtfpl | wtfpl
wtfpl | what the fuck you want to | do what the fuck you want to public license
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | creative commons zero | creative commons zero(?: license)?
cc-by | cc by | cc by(?: [1-4] [05])?(?= (?!nc |sa |nd ))
cc-by-sa | cc by sa | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-nc | cc by nc | cc by nc(?: [1-4] [05])?(?= (?!sa |nd ))
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e
cc-by-sa | creative commons attribution | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e
cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?:works)?(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e
cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e
cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: public)? licen[cs]e
cc | creative commons licen | creative commons licen[cs]e
odbl-1.0 | open database licen | open database licen[cs]e
odc-by-1.0 | open data commons attribution | open data commons attribution licen[cs]e
pddl-1.0 | public domain dedication and licen | public domain dedication and licen[cs]e
cdla-permissive | community data license agreement | community data license agreement permissive(?: [12] 0)?
cdla-sharing | community data license agreement | community data license agreement sharing(?: 1 0)?
ogl-uk | open government licen | open government licen[cs]e(?: (?:version |v ?)?[123] 0)?
ofl-1.1 | sil open font license | sil open font license(?: (?:version |v ?)?1 1)?
lppl-1.3 | latex project public license | latex project public license
vim | vim license | vim license
w3c | w3c | w3c(?: software| document)(?: notice and)? license
openssl | openssl | openssl(?: ssleay)? license
sleepycat | sleepycat | sleepycat(?: public)? license
qpl-1.0 | q public license | q public license(?: (?:version |v ?)?1(?: 0)?)?
zpl-2.1 | zope public license | zope public license(?: (?:version |v ?)?2(?: [01])?)?
upl-1.0 | universal permissive license | universal permissive license(?: (?:version |v ?)?1(?: 0)?)?
blueoak-1.0.0 | blue oak model license | blue oak model license(?: 1 0 0)?
mulan-2.0 | mulan | mulan permissive software license(?: (?:version |v ?)?2)?
openrail-m | openrail | (?:creativeml |bigscience )?(?:open ?rail|openrail) ?(?:m|plus plus m)?(?: license)
rail-1.0 | bigscience rail license | bigscience rail license(?: (?:version |v ?)?1 0)?
llama-community | llama | llama(?: [0-9]+)*(?: community)? license(?: agreement)?
gemma | gemma terms of use | gemma terms of use
apsl-2.0 | apple public source license | apple public source license(?: (?:version |v ?)?[12](?: [012])?)?
npl-1.1 | netscape public license | netscape public license(?: (?:version |v ?)?1 [01])?
spl-1.0 | sun public license | sun public license(?: (?:version |v ?)?1 0)?
rpl-1.5 | reciprocal public license | reciprocal public license(?: (?:version |v ?)?1 [15])?
"""

#: Sentences and addresses of particular licenses: label | keyword | expression.
TEXTS = r"""
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | may be used to endorse or promote products | neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
zlib | in no event will the authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
apache-2 | you may not use this file except in compliance | you may not use this file except in compliance with the license
bsl-1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
public-domain | public domain | (?:released|dedicated|placed|donated|put) (?:in|into|to) the public domain
public-domain | public domain | (?:this work|this file|this software|this code) (?:is|has been) (?:in )?the public domain
all-rights-reserved | all rights reserved | copyright (?:c )?(?:\S+ ){0,8}all rights reserved
gpl | free software you can redistribute it | free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | free software you can redistribute it | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | free software you can redistribute it | free software you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2.0 | source code form is subject to the terms | this source code form is subject to the terms of the mozilla public license v 2 0
gfdl | permission is granted to copy distribute | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mit | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php)?
bsd | opensource org licenses bsd | opensource org licenses bsd license(?: php)?
apache-2 | apache org licenses license 2 0 | apache org licenses license 2 0
gpl-2.0 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org licenses | gnu org licenses gpl 3 0
gpl | gnu org licenses gpl | gnu org licenses gpl
lgpl | gnu org licenses lgpl | gnu org licenses lgpl(?: [23] [01])?
agpl | gnu org licenses agpl | gnu org licenses agpl(?: 3 0)?
gfdl | gnu org licenses fdl | gnu org licenses fdl(?: 1 [123])?
mpl-2.0 | mozilla org mpl 2 0 | mozilla org mpl 2 0
mpl-2.0 | mozilla org en us mpl 2 0 | mozilla org en us mpl 2 0
epl-2.0 | eclipse org legal epl | eclipse org legal epl (?:2 0|v20)
epl-1.0 | eclipse org legal epl | eclipse org legal epl v10
cc-by | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: 1 0)?
ofl-1.1 | scripts sil org ofl | scripts sil org ofl
bsl-1.0 | boost org license 1 0 | boost org license 1 0
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
"""

#: What stands before a name where a license is granted, declared in a header or named in a tag.
_GRANT = r"(?:licen[cs]ed|released|distributed|redistributed|published|available|provided|covered|offered|governed|shared|redistribute it and or modify it) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? |either )?"
_FIELD = r"licen[cs]e (?:is |type |name |text |info )?(?:the )?"
_TAG = r"spdx license identifier "
#: Kinds of rules with priority and confidence; base phrases come before all.
KINDS = {"base": (100, 1.0), "tag": (80, 0.98), "grant": (60, 0.95), "text": (50, 0.9), "field": (45, 0.8), "name": (40, 0.7)}


@dataclass(frozen=True)
class LicenseRule:
    """One signature: ``pattern`` is matched between the spaces around words; ``keyword`` stands in each match."""

    label: str
    keyword: str
    pattern: str
    kind: str

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def confidence(self) -> float:
        return KINDS[self.kind][1]


def _entries(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ", 2)] for line in table.strip().splitlines()]


@lru_cache(maxsize=1)
def default_rules() -> tuple[LicenseRule, ...]:
    """Base phrases, then tags, grants, whole sentences, fields and bare names, each in the order of its table."""
    names = _entries(NAMES)
    tags = sorted(dict.fromkeys(x[0] for x in names), key=lambda x: -len(x))  # of equal intervals the longer name's
    rules = [LicenseRule(label, phrase, phrase, "base") for phrase, label in BASE.items()]
    for label in tags:
        words = re.sub(r"[^a-z0-9]+", " ", label)
        rules.append(LicenseRule(label, f"identifier {words}", rf"{_TAG}{words}(?: [0-9]+){{0,2}}(?: only)?", "tag"))
    rules += [LicenseRule(label, key, _GRANT + f"(?:{p})", "grant") for label, key, p in names]
    rules += [LicenseRule(label, key, p, "text") for label, key, p in _entries(TEXTS)]
    rules += [LicenseRule(label, key, _FIELD + f"(?:{p})", "field") for label, key, p in names]
    rules += [LicenseRule(label, key, p, "name") for label, key, p in names]
    return tuple(rules)


# Every ASCII byte that stands in no word becomes a space, and A-Z become a-z; other bytes stay.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def word_line(text: str | None) -> tuple[str, int]:
    """The words of a text between single spaces, one character a byte, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return (b" ".join([b"", *words, b""])).decode("latin-1"), len(words)


class Scanner:
    """Rules ready to run: expressions by number, and an automaton from keywords to those that need them."""

    def __init__(self, rules: tuple[LicenseRule, ...]):
        self.rules = rules
        self.patterns = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in rules]
        by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            by_keyword.setdefault(r.keyword, []).append(k)
        self.gate = ahocorasick.Automaton()
        for keyword, ks in by_keyword.items():
            self.gate.add_word(keyword, tuple(ks))
        self.gate.make_automaton()

    def gated(self, line: str) -> list[int]:
        """Numbers of the rules whose keyword occurs, in order."""
        return sorted({k for hit in {ks for _, ks in self.gate.iter(line)} for k in hit})

    def matches(self, line: str, which: list[int]) -> list[tuple[int, int, int]]:
        """(rule, start, end) of these rules, in characters of the line."""
        return [(k, *m.span()) for k in which for m in self.patterns[k].finditer(line)]

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What suppression leaves, by place.

        By descending priority: an interval goes where one that began no later has reached its
        end already; within a priority, longer ones come first where they begin together.
        """
        left, starts, ends = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for priority in sorted({self.rules[k].priority for k, _, _ in found}, reverse=True):
            group, reach = sorted((x for x in found if self.rules[x[0]].priority == priority), key=lambda x: (x[1], -x[2], x[0])), -1
            at = np.searchsorted(starts, [s for _, s, _ in group], side="right") - 1
            for (k, s, e), i in zip(group, at.tolist(), strict=True):
                if self.rules[k].kind == "base" or (e > reach and (i < 0 or ends[i] < e)):
                    left.append((k, s, e))
                reach = max(reach, e)
            order = sorted((s, e) for _, s, e in left)
            starts = np.array([s for s, _ in order], np.int64)
            ends = np.maximum.accumulate(np.array([e for _, e in order], np.int64)) if order else ends
        return sorted(left, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words, and (rule, first word, word after the last) of what is left."""
        line, n = word_line(text)
        which = self.gated(line)
        left = self.resolved(self.matches(line, which)) if which else []
        if not left:
            return n, []
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        word = lambda x: int(np.searchsorted(spaces, x))
        return n, [(k, word(s) - 1, word(e)) for k, s, e in left]


@lru_cache(maxsize=4)
def _scanner(rules: tuple[LicenseRule, ...]) -> Scanner:
    return Scanner(rules)


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("confidence", pa.float64())]))
_SCANNED = "doc_id long, n_words long, found array<struct<label:string,kind:string,first:bigint,after:bigint,confidence:double>>"


def license_spans(docs: DataFrame, rules: tuple[LicenseRule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, found) per row of ``docs``: matches by place, in words, as (label, kind, first, after, confidence)."""
    rules = rules or default_rules()

    def run(batches):
        scanner = _scanner(rules)
        for b in batches:
            words, found = [], []
            for t in b.column(1):
                n, left = scanner.scan(t.as_py())
                words.append(n)
                found.append([{"label": rules[k].label, "kind": rules[k].kind, "first": s, "after": e, "confidence": rules[k].confidence} for k, s, e in left])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "n_words", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCANNED)


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    found = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda f: f["kind"] == "base")
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda f: f["label"]))), ",")
    firsts = F.transform(base, lambda f: f["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["confidence"])), F.lit(0.0)).alias("score"),
    )
