"""License scans by ordered signature rules.

A text becomes its words (A-Z lowered), joined by single blanks, so that line breaks and
punctuation do not matter. Several hundred signatures, each a regular expression over that
form, are gated by keywords: one automaton pass over the text tells which families can occur at
all, and only their signatures run, in order of priority. A detection whose interval lies
within one already kept is suppressed, so "Apache License, Version 2.0" is not also reported as
a bare "Apache License".

Signatures are written per family and per form (identifier, address, grant, title with
version, name); the table of all rules is their product.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import byte_texts, map_rows, texts

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Bytes to words: A-Z lowered, other ASCII that is neither digit nor letter becomes a blank.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


@dataclass(frozen=True)
class Signature:
    """``keyword`` stands in every match; a higher priority wins over what lies within it."""

    label: str
    form: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


#: label, keyword, name, versions (written as words), short identifier.
FAMILIES = (
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0"), "apache"),
    ("mit", "mit", r"mit (?:x11 )?licen[sc]e", (), "mit"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", ("1", "2", "3"), "gpl"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2", "2 1", "3"), "lgpl"),
    ("agpl", "general public", r"(?:gnu )?affero general public licen[sc]e", ("1", "3"), "agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3"), "gfdl"),
    ("bsd", "bsd", r"(?:(?:new|modified|simplified|revised) )?bsd licen[sc]e", (), "bsd"),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[sc]e)?", (), "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[sc]e)?", (), "bsd 3 clause"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1 0", "2 0"), "epl"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1 0", "1 1"), "cddl"),
    ("cpl", "common public", r"common public licen[sc]e", ("1 0",), "cpl"),
    ("eupl", "european union", r"european union public licen[sc]e", ("1 1", "1 2"), "eupl"),
    ("isc", "isc", r"isc licen[sc]e", (), "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", (), "zlib"),
    ("boost", "boost", r"boost software licen[sc]e", ("1 0",), "bsl"),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1 0", "2 0"), "artistic"),
    ("unlicense", "unlicen", r"unlicen[sc]e", (), "unlicense"),
    ("wtfpl", "want to public", r"do what the [a-z]+ you want to public licen[sc]e", ("2",), "wtfpl"),
    ("psf", "python", r"python (?:software foundation )?licen[sc]e", ("2",), "psf"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", (), "postgresql"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1"), "ofl"),
    ("osl", "open software", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("afl", "academic free", r"academic free licen[sc]e", ("1 1", "2 0", "2 1", "3 0"), "afl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", (), "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", (), "ms rl"),
    ("odbl", "database", r"open (?:data commons )?database licen[sc]e", ("1 0",), "odbl"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", (), "cc0"),
    ("cc-by", "cc by", r"cc by", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by"),
    ("cc-by-sa", "cc by", r"cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by sa"),
    ("cc-by-nc", "cc by", r"cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc"),
    ("cc-by-nd", "cc by", r"cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nd"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc sa"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc nd"),
    ("cc-by", "creative commons", r"creative commons attribution", ("2 0", "2 5", "3 0", "4 0"), ""),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", ("2 0", "3 0", "4 0"), ""),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", ("2 0", "3 0", "4 0"), ""),
    ("vim", "vim", r"vim licen[sc]e", (), "vim"),
    ("ruby", "ruby", r"ruby licen[sc]e", (), "ruby"),
    ("php", "php", r"php licen[sc]e", ("3 0", "3 01"), "php"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", (), "ncsa"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1 0",), "upl"),
    ("sspl", "server side", r"server side public licen[sc]e", ("1",), "sspl"),
    ("busl", "business source", r"business source licen[sc]e", ("1 1",), "busl"),
)

#: Sentences that stand for a license without naming it; addresses.
SENTENCES = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 95, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 95, 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 92, 0.9),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products", 95, 0.9),
    ("gpl", "free software", r"this program is free software you can redistribute it", 92, 0.9),
    ("unlicense", "public domain", r"released into the public domain", 85, 0.7),
    ("public-domain", "public domain", r"(?:dedicated to|placed in|in) the public domain", 84, 0.6),
    ("boost", "hereby granted", r"permission is hereby granted free of charge to any person or organization", 96, 0.95),
    ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty", 85, 0.7),
    ("apache", "apache org", r"(?:www )?apache org licenses(?: license 2 0)?", 90, 0.9),
    ("gpl", "gnu org", r"(?:www )?gnu org (?:copyleft|licenses) gpl", 90, 0.9),
    ("lgpl", "gnu org", r"(?:www )?gnu org (?:copyleft|licenses) lgpl", 90, 0.9),
    ("mit", "opensource org", r"opensource org licenses mit", 90, 0.9),
    ("bsd", "opensource org", r"opensource org licenses bsd", 90, 0.9),
    ("mpl", "mozilla org", r"(?:www )?mozilla org mpl", 90, 0.9),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by", 88, 0.9),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa", 89, 0.9),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero", 90, 0.9),
    ("proprietary", "all rights", r"all rights reserved", 10, 0.2),
)

_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules, highest priority first."""
    out = []
    for label, keyword, name, versions, short in FAMILIES:
        out += [
            Signature(label, "grant", keyword, _GRANT + name, 70, 0.9),
            Signature(label, "terms", keyword, rf"(?:under|see|to) the terms of (?:the )?{name}", 60, 0.8),
            Signature(label, "header", keyword, rf"licen[sc]e {name}", 50, 0.7),
            Signature(label, "name", keyword, name, 40, 0.6),
        ]
        if short:
            out += [
                Signature(label, "identifier", "spdx", rf"spdx licen[sc]e identifier {short}", 100, 1.0),
                Signature(label, "field", short.split()[0], rf"licen[sc]e {short}", 45, 0.6),
            ]
        for version in versions:
            tag = f"{label}-{version.replace(' ', '.')}"
            number = rf"(?:v(?:ersion)? ?)?{version}"
            out += [
                Signature(tag, "grant", keyword, rf"{_GRANT}{name} {number}", 80, 0.95),
                Signature(tag, "title", keyword, rf"{name} {number}", 75, 0.9),
            ]
            if short:
                out.append(Signature(tag, "identifier", "spdx", rf"spdx licen[sc]e identifier {short} {version}", 110, 1.0))
    out += [Signature(label, "text", keyword, pattern, priority, sure) for label, keyword, pattern, priority, sure in SENTENCES]
    return tuple(sorted(out, key=lambda s: (-s.priority, s.label, s.form, s.pattern)))


@cache
def _gate():
    """Automaton over all keywords; keyword to its compiled signatures in order."""
    import ahocorasick

    by: dict[str, list] = {}
    for order, s in enumerate(signatures()):
        by.setdefault(s.keyword, []).append((order, s, re.compile(rf"(?<![^ ])(?:{s.pattern})(?![^ ])")))
    automaton = ahocorasick.Automaton()
    for keyword in by:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton, by


def normalised(text: bytes) -> tuple[bytes, int]:
    """Words joined by one blank, and their number."""
    words = text.translate(_WORD_BYTES).split()
    return b" ".join(words), len(words)


def detections(words: str) -> list[tuple[int, int, Signature]]:
    """(start, end, signature) in the normalised text, by start; contained ones are suppressed.

    Candidates are taken by priority, then the longer, then the earlier. One that lies within a
    kept interval goes; equal intervals keep the higher priority only.
    """
    automaton, by = _gate()
    present = {keyword for _, keyword in automaton.iter(words)}
    found = sorted(
        ((-s.priority, m.start() - m.end(), m.start(), order, m.end(), s) for k in present for order, s, p in by[k] for m in p.finditer(words)),
        key=lambda x: x[:4],
    )
    # Kept intervals that lie within no other: starts and ends both grow along these lists, so
    # the last one that begins at or before a start reaches furthest.
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for _, _, start, _, end, s in found:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        upto = at
        while upto < len(ends) and ends[upto] <= end:
            upto += 1
        first = at - 1 if at and starts[at - 1] == start else at
        starts[first:upto], ends[first:upto] = [start], [end]
        kept.append((start, end, s))
    return sorted(kept, key=lambda x: x[:2])


def word_numbers(words: bytes, positions: list[int]) -> list[int]:
    """Number of blanks before each position."""
    if not positions:
        return []
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
    return np.searchsorted(blanks, positions).tolist()


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase."""
    padded = b" " + words + b" "
    places, labels = [], []
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at = padded.find(wanted)
        while at >= 0:
            places.append(at)
            labels.append(label)
            at = padded.find(wanted, at + 1)
    return list(zip(word_numbers(padded, places), labels, strict=True))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``found`` holds (label, form, first, last): first and end word of each kept detection. The
    score is one minus the product of the detections' doubts. One row per input row; null and
    empty texts have no words and no labels (empty strings), null first and last word, score 0.
    Repeated rows stay, a null doc_id stays null, other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> dict:
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")
        out: dict = {k: [] for k in names}
        for text in byte_texts(batch.column("text")):
            words, n = normalised(text)
            base = base_places(words)
            found = detections(words.decode("latin-1"))
            at = [k for k, _ in base]
            doubt = 1.0
            for _, _, s in found:
                doubt *= 1 - s.confidence
            first = word_numbers(words, [a for a, _, _ in found])
            last = word_numbers(words, [b for _, b, _ in found])
            base_labels = {label for _, label in base}
            row = (
                n,
                len(base),
                min(at, default=None),
                max(at, default=None),
                ",".join(sorted(base_labels)),
                ",".join(sorted(base_labels | {s.label for _, _, s in found})),
                1 - doubt if found else float(bool(base)) * 0.5,
                [
                    {"label": s.label, "form": s.form, "first": a, "last": b + 1}
                    for a, b, (_, _, s) in zip(first, last, found, strict=True)
                ],
            )
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        return {"doc_id": batch.column("doc_id")} | out

    return map_rows(
        texts(docs),
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, found array<struct<label:string,form:string,first:long,last:long>>",
    )
