"""Secret scans by a trigram inverted index.

Each rule is a regular expression. ``trigram_query`` derives from its parse tree a Boolean
query over three-byte strings that every match must hold. A shard of rows (one slice of an
Arrow batch) is indexed: trigram to sorted row numbers, for the trigrams that some rule asks
for. Postings are intersected and united as the query says, and only the remaining candidates
are verified by the expression. Rules whose query is empty scan every row.

The index is per shard, as in any document-partitioned index: no posting list is shuffled, and
a trigram that every document holds costs no more than a column of one shard.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from re import _constants as code
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_rows, texts

#: Literal alternatives beyond which an expression counts as arbitrary text.
WIDEST = 16


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters or more; spans are those of the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII


#: The three base rules.
BASE = (
    Rule(
        "assign",
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        re.ASCII | re.IGNORECASE,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: A private key from its BEGIN line to its END line. Where another mark or the text's end comes first, the
#: header fields and base64 lines that follow, and a last line that is shorter. Line ends may be escaped or blanks.
_NEXT = r"(?:\s|\\[nrt]|[\"'>#,])++"
PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?:{_NEXT}(?:Proc-Type|DEK-Info):[^\n\\]*+)*+"
    rf"(?:{_NEXT}[A-Za-z0-9+/]{{20,}}+={{0,2}})*+"
    rf"(?:{_NEXT}[A-Za-z0-9+/]{{2,}}+={{1,2}}|{_NEXT}[A-Za-z0-9+/]++\Z"
    rf"|{_NEXT}(?<=\n)(?:[A-Za-z0-9+/]{{4}})++(?![^\s\\\"']))?)"
)
#: Rules of this scanner.
OWN = (
    Rule("private_key", PRIVATE_KEY),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"\b(?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{30,}"),
    Rule("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"\b[Bb]earer\x20+[A-Za-z0-9+/_.~-]{16,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@"),
)
RULES = BASE + OWN


# --- Boolean queries -------------------------------------------------------------------------
# A query is True (anything), a three-byte string, ("and", queries) or ("or", queries).


def _joined(kind: str, parts) -> object:
    """Nested parts of the same kind are flattened, repeated ones dropped."""
    flat: dict[object, None] = {}
    for part in parts:
        inner = part[1] if isinstance(part, tuple) and part[0] == kind else (part,)
        flat.update(dict.fromkeys(inner))
    return next(iter(flat)) if len(flat) == 1 else (kind, tuple(sorted(flat, key=repr)))


def _all(parts) -> object:
    parts = [p for p in parts if p is not True]
    return _joined("and", parts) if parts else True


def _any(parts) -> object:
    parts = list(parts)
    return True if True in parts or not parts else _joined("or", parts)


def _of_strings(strings: frozenset[str] | None) -> object:
    """Every match holds one of the strings, hence all trigrams of one of them."""
    if not strings:
        return True
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _glued(left: frozenset | None, right: frozenset | None) -> frozenset | None:
    if left is None or right is None or len(left) * len(right) > WIDEST:
        return None
    return frozenset(a + b for a in left for b in right)


def _node(op, value, fold: bool) -> tuple[frozenset | None, object]:
    """(all strings the node can match, or None; a query that holds for its matches)."""
    if op is code.LITERAL:
        c = chr(value)
        return frozenset([c.lower() if fold and value < 128 else c]), True
    if op is code.IN and len(value) <= WIDEST and all(o is code.LITERAL for o, _ in value):
        return frozenset(chr(v).lower() if fold and v < 128 else chr(v) for _, v in value), True
    if op is code.SUBPATTERN:
        return _sequence(value[3], fold)
    if op is code.BRANCH:
        sides = [_sequence(branch, fold) for branch in value[1]]
        query = _any([_all([_of_strings(s), q]) for s, q in sides])
        if all(s is not None for s, _ in sides):
            joined = frozenset().union(*(s for s, _ in sides))
            if len(joined) <= WIDEST:
                return joined, query
        return None, query
    if op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _sequence(body, fold)
        if strings is not None and (low, high) == (0, 1):
            return (strings | {""}) if len(strings) < WIDEST else None, True
        if low == 0:
            return None, True
        once = _all([_of_strings(strings), query])
        if strings is not None and low == high:
            out: frozenset | None = frozenset([""])
            for _ in range(low):
                out = _glued(out, strings)
            return out, once
        return None, once
    if op is code.AT:
        return frozenset([""]), True
    return None, True


def _sequence(items, fold: bool) -> tuple[frozenset | None, object]:
    """A run of nodes: exact strings are glued as long as they stay few; a break ends the run."""
    whole, run, queries = True, frozenset([""]), []
    for op, value in items:
        strings, query = _node(op, value, fold)
        if query is not True:
            queries.append(query)
        glued = _glued(run, strings)
        if glued is None:
            queries.append(_of_strings(run))
            whole = False
            run = strings if strings is not None and len(strings) <= WIDEST else frozenset([""])
        else:
            run = glued
    queries.append(_of_strings(run))
    return (run if whole else None), _all(queries)


@cache
def trigram_query(pattern: str, flags: int = 0) -> object:
    """The query of an expression, in lower-case ASCII; True if no trigram is mandatory."""

    def lowered(query):
        if query is True:
            return True
        if isinstance(query, str):
            return query.lower() if query.isascii() else True
        kind, parts = query
        return (_all if kind == "and" else _any)([lowered(p) for p in parts])

    strings, query = _sequence(parser.parse(pattern, flags), bool(flags & re.IGNORECASE))
    return lowered(_all([_of_strings(strings), query]))


def mentioned(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(mentioned(p) for p in query[1]))


# --- The index of a shard --------------------------------------------------------------------


class Index:
    """Trigram to sorted row numbers, for the trigrams that the queries mention."""

    STEP = 1 << 20

    def __init__(self, rows: list[bytes], wanted: set[str]):
        self.rows = len(rows)
        numbers = {t: k for k, t in enumerate(sorted(wanted))}
        slot = _slots(tuple(sorted(wanted)))
        found = []
        # Rows are joined by two zero bytes, which no wanted trigram crosses.
        joined = np.frombuffer(b"\0\0".join(rows) + b"\0\0", np.uint8)
        begins = np.cumsum([0, *(len(r) + 2 for r in rows)])
        for start in range(0, joined.size, self.STEP):
            part = _LOWER[joined[start : start + self.STEP + 2]]
            if part.size < 3:
                break
            codes = (part[:-2].astype(np.int32) << 16) | (part[1:-1].astype(np.int32) << 8) | part[2:]
            hit = slot[codes]
            at = np.flatnonzero(hit)
            owner = np.searchsorted(begins, at + start, side="right") - 1
            found.append(np.unique(owner * np.int64(1 << 16) + hit[at] - 1))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        term, row = pairs & 0xFFFF, pairs >> 16
        order = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[order], np.arange(len(numbers) + 1))
        self.postings = {t: row[order[cuts[k] : cuts[k + 1]]] for t, k in numbers.items()}

    def candidates(self, query) -> np.ndarray:
        """Sorted rows that satisfy the query."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        kind, parts = query
        sets = sorted((self.candidates(p) for p in parts), key=len)
        out = sets[0]
        for other in sets[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if kind == "and" else np.union1d(out, other)
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@cache
def _slots(wanted: tuple[str, ...]) -> np.ndarray:
    """Trigram code to its number plus one, 0 for those nobody asks for."""
    out = np.zeros(1 << 24, np.uint16)
    for k, t in enumerate(wanted):
        a, b, c = t.encode()
        out[(a << 16) | (b << 8) | c] = k + 1
    return out


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap; matches whose group is too short are dropped."""
    return [
        m.span()
        for m in re.compile(rule.pattern, rule.flags).finditer(text)
        if len(m.group(rule.group)) >= rule.least
    ]


def scan_rows(rows: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each row's matches, by start, then in the order of the rules."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    index = Index(rows, set().union(*map(mentioned, queries)))
    decoded: dict[int, str] = {}
    found: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for row in index.candidates(query).tolist():
            if row not in decoded:
                decoded[row] = rows[row].decode("utf-8", "surrogateescape")
            found[row] += [(start, order, end) for start, end in find(rule, decoded[row])]
    return [[(rules[k].kind, start, end) for start, k, end in sorted(row)] for row in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array of (kind, first, last) in code points, end exclusive.

    One row per input row, also for repeated rows; null and empty texts have no spans, a null
    doc_id stays null, an empty table gives an empty table, other columns are not carried.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        spans = [
            [{"kind": k, "first": a, "last": b} for k, a, b in row] for row in scan_rows(rows, rules)
        ]
        return {"doc_id": batch.column("doc_id"), "spans": spans}

    return map_rows(texts(docs), run, "doc_id long, spans array<struct<kind:string,first:long,last:long>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with ``[kind]`` for each span; overlapping spans become one, of the first one's kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])
