"""License detection by ordered signature rules.

A text becomes its lower-cased words, one blank apart; rules are regular expressions over that line, written by hand:
sentences of license texts and notices (`TEXTS`), a table of license families (names, short names, versions) in a
handful of phrase forms, SPDX tags and "or later" grants among them, and exceptions (`EXCEPTIONS`, which have labels of
their own), each with a priority and a score. A rule runs only if a keyword of it stands in the text. All operands of an
SPDX expression are detections. Signs are no words, but a plus right behind the version of a GNU license ("LGPL-2.1+")
makes its label "or later". Where detections overlap, priority decides: a detection that lies within one of
higher priority, or of the same priority and longer, is dropped (ties: the earlier place, then the rule's name). Scanning
takes time in proportion to the text, suppression n log n for n detections.

The three base phrases are found apart from this, at all their places, and are never suppressed.

Defined results: null and empty texts have no words, no detections and score 0; repeated rows are scanned one by one;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import LOWER, UPPER, per_worker

#: The base phrases and their labels.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}

#: Families: label stem, full names, short names, versions ("" for none). Names are regular expressions over words.
FAMILIES = [
    ("mit", ["(?:the )?mit licen[sc]e", "expat licen[sc]e"], ["mit"], [""]),
    ("mit-0", ["mit no attribution licen[sc]e"], ["mit 0"], [""]),
    ("x11", ["x11 licen[sc]e"], [], [""]),
    ("isc", ["isc licen[sc]e", "internet software consortium licen[sc]e"], ["isc"], [""]),
    ("zlib", ["zlib(?: libpng)? licen[sc]e"], [], [""]),
    ("bsd-2-clause", ["(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e", "bsd (?:2|two) clause(?: licen[sc]e)?"], [], [""]),
    ("bsd-3-clause", ["(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e", "bsd (?:3|three) clause(?: licen[sc]e)?"], [], [""]),
    ("bsd-4-clause", ["(?:original|4 clause|four clause) bsd licen[sc]e", "bsd (?:4|four) clause(?: licen[sc]e)?"], [], [""]),
    ("0bsd", ["zero clause bsd(?: licen[sc]e)?", "bsd zero clause(?: licen[sc]e)?"], ["0bsd"], [""]),
    ("bsd", ["bsd(?: style)? licen[sc]e"], [], [""]),
    ("apache", ["apache(?: software)? licen[sc]e"], ["apache", "asl"], ["1.0", "1.1", "2.0"]),
    ("agpl", ["(?:gnu )?affero general public licen[sc]e"], ["(?:gnu )?agpl"], ["1.0", "3.0"]),
    ("lgpl", ["(?:gnu )?(?:lesser|library) general public licen[sc]e"], ["(?:gnu )?lgpl"], ["2.0", "2.1", "3.0"]),
    ("gpl", ["(?:gnu )?general public licen[sc]e"], ["(?:gnu )?gpl"], ["1.0", "2.0", "3.0"]),
    ("gfdl", ["(?:gnu )?free documentation licen[sc]e"], ["(?:gnu )?fdl", "(?:gnu )?gfdl"], ["1.1", "1.2", "1.3"]),
    ("mpl", ["mozilla public licen[sc]e"], ["mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public licen[sc]e"], ["epl"], ["1.0", "2.0"]),
    ("cpl", ["common public licen[sc]e"], ["cpl"], ["1.0"]),
    ("ipl", ["ibm public licen[sc]e"], [], ["1.0"]),
    ("cddl", ["common development and distribution licen[sc]e"], ["cddl"], ["1.0", "1.1"]),
    ("eupl", ["european union public licen[sc]e"], ["eupl"], ["1.0", "1.1", "1.2"]),
    ("artistic", ["(?:perl )?artistic licen[sc]e"], [], ["1.0", "2.0"]),
    ("osl", ["open software licen[sc]e"], ["osl"], ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free licen[sc]e"], ["afl"], ["1.2", "2.0", "2.1", "3.0"]),
    ("bsl", ["boost software licen[sc]e"], [], ["1.0"]),
    ("busl", ["business source licen[sc]e"], ["busl"], ["1.1"]),
    ("ofl", ["(?:sil )?open font licen[sc]e"], ["(?:sil )?ofl"], ["1.0", "1.1"]),
    ("upl", ["universal permissive licen[sc]e"], ["upl"], ["1.0"]),
    ("zpl", ["zope public licen[sc]e"], ["zpl"], ["1.1", "2.0", "2.1"]),
    ("ms-pl", ["microsoft public licen[sc]e"], ["ms pl"], [""]),
    ("ms-rl", ["microsoft reciprocal licen[sc]e"], ["ms rl"], [""]),
    ("ncsa", ["university of illinois (?:ncsa )?open source licen[sc]e"], [], [""]),
    ("postgresql", ["postgresql licen[sc]e"], [], [""]),
    ("psf", ["python software foundation licen[sc]e"], ["psf licen[sc]e"], ["2.0"]),
    ("php", ["php licen[sc]e"], [], ["3.0", "3.01"]),
    ("openssl", ["openssl licen[sc]e"], [], [""]),
    ("w3c", ["w3c software (?:notice and )?licen[sc]e"], [], [""]),
    ("vim", ["vim licen[sc]e"], [], [""]),
    ("json", ["json licen[sc]e"], [], [""]),
    ("unlicense", ["(?:the )?unlicense"], [], [""]),
    ("wtfpl", ["do what the fuck you want to public licen[sc]e"], ["wtfpl"], ["", "2.0"]),
    ("beerware", ["beerware licen[sc]e", "beer ware licen[sc]e"], [], [""]),
    ("pddl", ["public domain dedication and licen[sc]e"], ["pddl"], ["1.0"]),
    ("odbl", ["open (?:data commons open )?database licen[sc]e"], ["odbl"], ["1.0"]),
    ("odc-by", ["open data commons attribution licen[sc]e"], ["odc by"], ["1.0"]),
    ("cc0", ["creative commons (?:cc0|zero)"], ["cc0", "cc zero"], ["", "1.0"]),
    ("public-domain", ["dedicated to the public domain", "released into the public domain"], [], [""]),
]
#: Creative Commons: parts of the label and the words for them.
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|covered|offered) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?(?:a )?"

#: Sentences of license texts and standard notices: label, keyword, pattern over words.
TEXTS = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsl-1.0", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "(?:neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors|the names? of (?:[^ ]+ ){1,12})may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache", "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", "to the extent possible under law (?:[^ ]+ ){1,15}(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("ofl-1.1", "font", "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("artistic", "artistic", "you may distribute under the terms of either the gnu general public licen[sc]e or the artistic licen[sc]e"),
    ("ncsa", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
]
#: Of the GNU licenses: the notice that names the version.
GNU_NOTICES = [("gpl", "general", ["1.0", "2.0", "3.0"]), ("lgpl", "(?:lesser|library) general", ["2.0", "2.1", "3.0"]), ("agpl", "affero general", ["1.0", "3.0"])]
#: Exceptions to licenses: label, keyword, pattern over words.
EXCEPTIONS = [
    ("autoconf-exception", "autoconf", "autoconf exception(?: [23] 0)?"),
    ("bison-exception-2.2", "bison", "bison exception(?: 2 2)?"),
    ("classpath-exception-2.0", "classpath", "classpath exception(?: 2 0)?"),
    ("classpath-exception-2.0", "exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable"),
    ("font-exception-2.0", "font", "font exception(?: 2 0)?"),
    ("gcc-exception", "gcc", "(?:gcc exception(?: [23] [01])?|gcc runtime library exception)"),
    ("libtool-exception", "libtool", "libtool exception"),
    ("linux-syscall-note", "syscall", "linux syscall note"),
    ("llvm-exception", "llvm", "llvm exceptions?"),
    ("openssl-exception", "openssl", "(?:openssl (?:linking )?exception|permission to link (?:[^ ]+ ){1,12}with the openssl (?:project s )?(?:library|openssl library))"),
    ("qt-gpl-exception-1.0", "qt", "qt gpl exception(?: 1 0)?"),
    ("qt-lgpl-exception-1.1", "qt", "qt lgpl exception(?: 1 1)?"),
    ("u-boot-exception-2.0", "boot", "u boot exception(?: 2 0)?"),
    ("wxwindows-exception-3.1", "wxwindows", "wxwindows exception(?: 3 1)?"),
]
#: Behind "licensed" these tell of somebody who licensed something, not of a license.
OBJECTS = "to|the|its|their|his|her|our|it|them|this|that|these|those|a|an|some|several|patents?|technology|technologies"
#: Short names that stand for a license even alone.
DISTINCT = {"wtfpl", "0bsd", "cc0"}


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    score: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def families() -> list[tuple[str, list[str], list[str], list[str]]]:
    made = list(FAMILIES)
    for kind in CC_KINDS:
        parts = kind.split("-")
        name = "creative commons " + " ".join(CC_PARTS[p] for p in parts)
        made.append((f"cc-{kind}", [name], ["(?:creative commons )?cc " + " ".join(parts)], ["", *CC_VERSIONS]))
    return made


def keywords(names: list[str]) -> tuple[bytes, ...]:
    """A plain word of each name, the longest: no name matches a text without its own (digits may follow it)."""
    runs = [re.findall(r"[a-z0-9]+", re.sub(r"\(\?:[^()]*\)\??|\w+\[[^]]*\]\w*|\w* ?\?\w*", " ", n)) for n in names]
    return tuple(dict.fromkeys(max(r, key=len).encode() for r in runs))


def rules() -> list[Rule]:
    """All rules, in order of priority (the lowest number decides)."""
    made = []

    def add(name: str, label: str, priority: int, score: float, pattern: str, keys: tuple[bytes, ...]) -> None:
        made.append(Rule(name, label, priority, score, keys, re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode())))

    for stem, full, short, versions in families():
        names, every = f"(?:{'|'.join(full)})", f"(?:{'|'.join(full + short)})"
        for v in versions:
            label = f"{stem}-{v}" if v else stem
            digits = v.replace(".", " ")
            if v.endswith(".0"):
                digits = f"{v[:-2]}(?: 0)?"
            number = f"(?: licen[sc]e)?(?: ?(?:version|ver|v))? ?{digits}" if v else ""
            later = f"(?:{GRANT})?{every}{number} (?:or (?:any|later|newer|at your option)|and (?:any|later|newer))(?: (?:any )?later)?(?: versions?)?"
            add(f"{label} tag", label, 0, 1.0, f"spdx licen[sc]e identifier {re.escape(stem).replace('-', ' ').replace(chr(92), '')}{' ' + digits if v else ''}", (b"spdx",))
            add(f"{label} grant", label, 1 if v else 3, 0.95 if v else 0.85, GRANT + every + number, keywords(full + short))
            add(f"{label} name", label, 2 if v else 4, 0.9 if v else 0.7, names + number, keywords(full))
            if v and ("gpl" in stem or stem == "gfdl"):
                add(f"{label} or later", f"{label}-or-later", 0, 1.0, later, keywords(full + short))
                add(f"{label} tag or later", f"{label}-or-later", 0, 1.0, f"spdx licen[sc]e identifier {stem} {v.replace('.', ' ')} or later", (b"spdx",))
            if v and short:
                add(f"{label} short", label, 2, 0.8, f"(?:{'|'.join(short)}){number}", keywords(short))
            if not v and DISTINCT & set(short):
                add(f"{label} short", label, 4, 0.6, f"(?:{'|'.join(sorted(DISTINCT & set(short)))})", keywords(short))
            # "MIT licensed", "Apache 2.0-licensed": gated by the participle, as some names are common words.
            if short or stem.isalnum():
                add(f"{label} participle", label, 2 if v else 4, 0.8 if v else 0.6, rf"(?:{'|'.join(short or [stem])}){number} licen[sc]ed(?! (?:{OBJECTS})(?![^ ]))", (b"licensed", b"licenced"))
        if "" not in versions:
            if short:
                add(f"{stem} participle", stem, 4, 0.6, rf"(?:{'|'.join(short)}) licen[sc]ed(?! (?:{OBJECTS})(?![^ ]))", (b"licensed", b"licenced"))
            add(f"{stem} grant", stem, 3, 0.8, GRANT + every, keywords(full + short))
            add(f"{stem} name", stem, 4, 0.6, names, keywords(full))
    for i, (label, key, pattern) in enumerate(TEXTS):
        add(f"{label} text {i}", label, 0, 1.0, pattern, (key.encode(),))
    for i, (label, key, pattern) in enumerate(EXCEPTIONS):
        add(f"{label} exception {i}", label, 0, 1.0, f"(?:with (?:the )?)?{pattern}", (key.encode(),))
    for stem, name, versions in GNU_NOTICES:
        for v in versions:
            number = f"either version {v.removesuffix('.0').replace('.', ' ')}(?: 0)? of the licen[sc]e or at your option any later version"
            add(f"{stem}-{v} notice", f"{stem}-{v}-or-later", 0, 1.0, f"under the terms of the gnu {name} public licen[sc]e as published by the free software foundation {number}", (b"foundation",))
    return sorted(made, key=lambda r: (r.priority, r.name))


def operands() -> dict[bytes, Rule]:
    """The rule for an operand of an SPDX expression, by the operand's words; longer ones first."""
    made = {}
    for stem, _, _, versions in families():
        for v in versions:
            label = f"{stem}-{v}" if v else stem
            spelled = label.replace("-", " ").replace(".", " ")
            gnu = v and ("gpl" in stem or stem == "gfdl")
            for words, to in [(spelled, label), *([(f"{spelled} only", label), (f"{spelled} or later", f"{label}-or-later")] if gnu else [])]:
                made[words.encode()] = Rule(f"{to} operand", to, 0, 1.0, (b"spdx",), re.compile(rf"(?<![^ ]){words}(?![^ ])".encode()))
    return dict(sorted(made.items(), key=lambda m: (-len(m[0]), m[0])))


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that lie within none of higher priority (or of the same and longer), by a tree of the furthest ends."""
    starts = sorted({a for a, _, _ in found})
    tree = [-1] * (len(starts) + 1)
    kept = []
    for a, z, r in sorted(found, key=lambda f: (f[2].priority, f[0] - f[1], f[0], f[2].name)):
        i, furthest = bisect.bisect_right(starts, a), -1
        while i:
            furthest = max(furthest, tree[i])
            i &= i - 1
        if furthest < z:
            kept.append((a, z, r))
            i = bisect.bisect_right(starts, a)
            while i < len(tree):
                tree[i] = max(tree[i], z)
                i += i & -i
    return sorted(kept, key=lambda f: f[:2])


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.keywords = {k for r in self.rules for k in r.keywords}
        self.operands = operands()
        one = b"(?:" + b"|".join(self.operands) + b")(?![^ ])"
        # Operands unknown here, of up to five words, don't end the expression; exceptions have rules of their own.
        part = b"(?:" + one + rb"|[^ ]+(?: [^ ]+){0,4}?(?= (?:and|or|with) ))"
        self.expression = re.compile(rb"(?<![^ ])spdx licen[sc]e identifier (" + part + rb"(?: (?:and|or|with) " + part + rb")*)")
        self.operand = re.compile(rb"(?<![^ ])" + one)
        #: Labels that a plus makes "or later".
        self.versions = {r.label.removesuffix("-or-later") for r in self.rules if r.label.endswith("-or-later")}
        # Separators to blanks, A-Z to a-z; bytes of other characters belong to words.
        table = bytearray(range(256))
        for c in range(128):
            table[c] = c if chr(c) in "0123456789" + LOWER else 32
        for a, b in zip(UPPER, LOWER, strict=True):
            table[ord(a)] = ord(b)
        self.table = bytes(table)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, str, float]]]:
        """Number of words; base places (first word, words, label); detections (first word, end, label, rule, score)."""
        words = text.translate(self.table).split()
        line = b" ".join(words)
        base: list[tuple[int, int, str]] = []
        # Where each word begins: a place's number of words before it.
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        before = lambda at: int(np.searchsorted(begins, at))
        for phrase, label in BASE.items():
            size = phrase.count(b" ") + 1
            at = line.find(phrase)
            while at >= 0:
                end = at + len(phrase)
                if (at == 0 or line[at - 1] == 32) and (end == len(line) or line[end] == 32):
                    base.append((before(at), size, label))
                at = line.find(phrase, at + 1)
        found: list[tuple[int, int, Rule]] = []
        there = set(words)
        there |= {w.rstrip(b"0123456789").rstrip(b"v") for w in there if w[-1] < 58}  # gplv3, cc0
        if there.isdisjoint(self.keywords):
            return len(words), base, []
        for r in self.rules:
            if there.isdisjoint(r.keywords):
                continue
            found += [(m.start(), m.end(), r) for m in r.pattern.finditer(line)]
        if b"spdx" in there:
            for e in self.expression.finditer(line):
                found += [(m.start(), m.end(), self.operands[m.group()]) for m in self.operand.finditer(line, e.start(1), e.end(1))]
        spans = [(before(a), before(z + 1), r.label, r.name, r.score) for a, z, r in unsuppressed(found)]
        if any(label in self.versions for _, _, label, _, _ in spans) and re.search(rb"[0-9]\+", text):
            held = np.frombuffer(text.translate(self.table) + b" ", np.uint8) != 32
            ends = np.flatnonzero(held[:-1] & ~held[1:]) + 1  # of each word, in the text
            spans = [(a, z, f"{label}-or-later" if label in self.versions and text[ends[z - 1] : ends[z - 1] + 1] == b"+" else label, name, score) for a, z, label, name, score in spans]
        return len(words), sorted(base), spans


FOUND = "array<struct<label:string,rule:string,first_word:long,end_word:long,score:double>>"
PLACES = "array<struct<label:string,first_word:long>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places of the base phrases, detections of the rules that no other rule suppresses."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker("license rules", Scanner)
        place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
        found = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            n, places, spans = [], [], []
            for text in b.column("text"):
                count, base, kept = scanner.scan(text.as_py() or b"")
                n.append(count)
                places.append([{"label": x, "first_word": a} for a, _, x in base])
                spans.append([{"label": x, "rule": r, "first_word": a, "end_word": z, "score": s} for a, z, x, r, s in kept])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, found)], names=["doc_id", "n_words", "places", "detections"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(scanned, f"doc_id long, n_words long, places {PLACES}, detections {FOUND}")


def licenses_query(docs: DataFrame) -> DataFrame:
    starts, labels = F.col("places.first_word"), F.col("places.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan_licenses(docs).select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.col("detections.label"))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("detections.score")), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )

