"""Token counts by a compiled finite-state tokenizer: no token is ever built.

A byte-fallback BPE model of the sentencepiece family is compiled into a deterministic transducer over
characters. Its state says, for every place before the current character where a token could still
be open, how far the token trie has been walked from there, the last token of the text up to
there, and the count up to there relative to now. A transition is annotated with the tokens it emits, which is
negative where a longer token swallows shorter ones. States and transitions are compiled when a text
first needs them.

Texts are cut into chunks and all chunks of a slice step together, one character a step. A chunk
whose first character no token can share with the one before it starts in the start state, so its state
map is constant. Where a text has no such place (long runs of one letter or of blanks), the chunk
gets a map over the states that 48 characters of run-up lead to from different places, and the maps
are composed by a parallel prefix scan. If the state that arrives is not in a chunk's map, the chunk is
run from that state, so the result never rests on the guess.

Two facts about merges carry the state: the tokens of a text are the only sequence in which every two
neighbours are the tokens of their joined text; and where no token holds two neighbouring
characters, the merges left and right of them do not touch each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, texts

#: Characters of a chunk, and how far its first place may move to where no token crosses.
CHUNK, SNAP = 512, 512
#: Run-up of a chunk that starts inside an unbroken run, and the places from which it is tried.
RUN_UP, STARTS = 48, 16
#: Characters of one text that are held as numbers at a time.
SEGMENT = 4_000_000
#: Transitions a worker keeps; when exceeded all are dropped and compiled again as needed.
KEPT = 4_000_000

_BLANK = "▁"
_ANY, _NONE, _MISS = -2, -1, -3
_loaded: dict[str, "Transducer"] = {}


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores that merges may make, from a sentencepiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    if sum(model.is_byte(i) for i in range(model.vocab_size())) != 256:
        raise ValueError("the model has no byte fallback")
    return [(model.id_to_piece(i), model.get_score(i)) for i in own]


class Merges:
    """Which tokens may stand side by side."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.score = dict(vocabulary)
        seen: dict[float, int] = {}
        for _, s in vocabulary:
            seen[s] = seen.get(s, 0) + 1
        # Pieces of one score are merged from the left; they are judged by running the merges.
        self.tied = {p for p, s in vocabulary if seen[s] > 1}
        self.tokens, self.left, self.right = [], {}, {}
        for piece, _ in vocabulary:
            parts, made = self.run(piece)
            if parts == [piece]:
                self.tokens.append(piece)
                # The symbol at either end, as it grows; each with the score that made it.
                self.left[piece] = [piece[0], *(piece[a:b] for a, b in made if a == 0)]
                self.right[piece] = [piece[-1], *(piece[a:b] for a, b in made if b == len(piece))]
        self.known: dict[tuple[str, str], bool] = {}

    def run(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The tokens of a short text and the spans of all symbols its merges made, in order.

        Each step joins the pair of the highest score, the leftmost of equals.
        """
        parts, made, score = list(text), [], self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            start = sum(map(len, parts[:at]))
            made.append((start, start + len(parts[at])))
        return parts, made

    def meet(self, first: str, second: str) -> bool:
        """Whether the joined text of two tokens has these two tokens."""
        key = first, second
        got = self.known.get(key)
        if got is None:
            if first in self.tied or second in self.tied:
                got = self.run(first + second)[0] == [first, second]
            else:
                got = self._race(self.right[first], self.left[second])
            self.known[key] = got
        return got

    def _race(self, ends: list[str], heads: list[str]) -> bool:
        """Symbols at the border grow on both sides, best score first; false once they would join."""
        score, i, j = self.score, 0, 0
        least = float("-inf")
        while True:
            a = score[ends[i + 1]] if i + 1 < len(ends) else least
            b = score[heads[j + 1]] if j + 1 < len(heads) else least
            joined = score.get(ends[i] + heads[j])
            if joined is not None and joined > a and joined >= b:
                return False
            if a == least and b == least:
                return True
            if a >= b:
                i += 1
            else:
                j += 1


class Transducer:
    """States and transitions compiled so far; all chunks of a slice are run together."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.merges = Merges(vocabulary)
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        long = [p for p in self.merges.tokens if len(p) > 1]
        letters = sorted({c for p in long for c in p})
        singles = {p for p in self.merges.tokens if len(p) == 1}
        if not singles.issuperset(letters):
            raise ValueError("a character of a longer piece is no piece")
        for piece in [*letters, *long]:
            node = 0
            for c in piece:
                nxt = self.trie[node].get(c)
                if nxt is None:
                    nxt = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                node = nxt
            self.ends[node] = piece
        # Symbols: the characters of longer pieces; one for all that stand alone; unknown ones by their bytes.
        n = len(letters)
        self.letters, self.shift = letters, int(n + 5).bit_length()
        self.symbol = np.full(0x110000, n + 4, np.int32)
        for size, below in ((3, 0x10000), (2, 0x800), (1, 0x80)):
            self.symbol[:below] = n + size
        self.symbol[[ord(c) for c in singles]] = n
        self.symbol[[ord(c) for c in letters]] = np.arange(n)
        place = {c: k for k, c in enumerate(letters)}
        self.apart = np.ones((n + 5, n + 5), bool)
        for p in long:
            for a, b in zip(p, p[1:]):
                self.apart[place[a], place[b]] = False
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.slots = 1 << 16
        self.keys = np.full(self.slots, -1, np.int64)
        self.next = np.zeros(self.slots, np.int32)
        self.emitted = np.zeros(self.slots, np.int32)
        self.held = 0
        n = len(self.letters)
        alone = np.arange(n, n + 5, dtype=np.int64)
        self._insert(alone, np.zeros(5, np.int32), np.array([1, 1, 2, 3, 4], np.int32))

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition of one state on one letter."""
        c, open_places, count, token = self.letters[symbol], [], None, None
        for node, last, before in self.states[state]:
            nxt = self.trie[node].get(c)
            if nxt is None:
                continue
            piece = self.ends[nxt]
            if count is None and piece is not None and (last is None or self.merges.meet(last, piece)):
                count, token = before + 1, piece
            if self.trie[nxt]:
                open_places.append((nxt, last, before))
        if count is None:
            raise ValueError("the vocabulary is not that of a merge tokenizer")
        new = (*((n, last, before - count) for n, last, before in open_places), (0, token, 0))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        return to, count

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def _insert(self, keys: np.ndarray, to: np.ndarray, emitted: np.ndarray) -> None:
        if 4 * (self.held + keys.size) > self.slots:
            used = self.keys >= 0
            old = self.keys[used], self.next[used], self.emitted[used]
            while 4 * (self.held + keys.size) > self.slots:
                self.slots *= 4
            self.keys = np.full(self.slots, -1, np.int64)
            self.next, self.emitted = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
            self.held = 0
            self._insert(*old)
        at = self._slot(keys)
        for k, key in enumerate(keys):
            i = at[k]
            while self.keys[i] >= 0:
                i = (i + 1) % self.slots
            self.keys[i], self.next[i], self.emitted[i] = key, to[k], emitted[k]
        self.held += keys.size

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each transition; those that are missing are compiled."""
        at = self._slot(keys)
        seen = self.keys[at]
        if (seen == keys).all():
            return at
        wrong = np.flatnonzero(seen != keys)
        while wrong.size:
            empty = wrong[self.keys[at[wrong]] < 0]
            if empty.size:
                new = np.unique(keys[empty])
                made = [self._step(int(k) >> self.shift, int(k) & ((1 << self.shift) - 1)) for k in new]
                self._insert(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int32))
                # The table may have grown, so all places are looked up anew.
                at = self._slot(keys)
                wrong = np.flatnonzero(self.keys[at] != keys)
            else:
                at[wrong] = (at[wrong] + 1) % self.slots
                wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return at

    def _run(self, symbols, apart, first, end, state) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of stretches ``first``..``end``, all stepping together."""
        size = end - first
        order = np.argsort(-size, kind="stable")
        at, now, total = first[order], state[order].astype(np.int64), np.zeros(first.size, np.int64)
        active = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
        for n in active.tolist():
            here = at[:n]
            keys = (np.where(apart[here], 0, now[:n]) << self.shift) | symbols[here]
            slot = self._find(keys)
            now[:n] = self.next[slot]
            total[:n] += self.emitted[slot]
            here += 1
        back = np.empty_like(order)
        back[order] = np.arange(order.size)
        return now[back], total[back]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        out, group, sizes = np.zeros(len(texts), np.int64), [], []
        for row, text in enumerate(texts):
            if not text:
                continue
            if len(text) > SEGMENT:
                state = None
                for begin in range(0, len(text), SEGMENT):
                    before = text[begin - 1] if begin else None
                    total, state = self._texts([text[begin : begin + SEGMENT]], state, before)
                    out[row] += total[0]
                continue
            group.append(row)
            sizes.append(len(text))
            if sum(sizes) > SEGMENT:
                out[group] = self._texts([texts[k] for k in group])[0]
                group, sizes = [], []
        if group:
            out[group] = self._texts([texts[k] for k in group])[0]
        return out

    def _texts(self, texts: list[str], entry: int | None = None, before: str | None = None) -> tuple[np.ndarray, int]:
        """Tokens of each text and the state after the last; ``entry`` and ``before`` carry on one text."""
        if self.held > KEPT and entry is None:
            self.clear()
        head = _BLANK if entry is None else ""
        points = np.frombuffer("".join(head + t for t in texts).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[np.where(points == 32, ord(_BLANK), points)].astype(np.int64)
        starts = np.cumsum([0, *(len(head) + len(t) for t in texts)])
        apart = np.empty(symbols.size, bool)
        apart[1:] = self.apart[symbols[:-1], symbols[1:]]
        apart[starts[:-1]] = True
        if entry is not None:
            last = self.symbol[ord(_BLANK if before == " " else before)]
            apart[0] = self.apart[last, symbols[0]]
        cuts = self._cuts(apart, starts)
        first, end = cuts, np.append(cuts[1:], symbols.size)
        forced = ~apart[first]
        if entry is not None and forced[0]:
            forced[0] = False
        begin = np.zeros(first.size, np.int64)
        if entry is not None:
            begin[0] = entry
        if not forced.any():
            exits, counts = self._run(symbols, apart, first, end, begin)
            last_state = exits[-1]
        else:
            counts, last_state = self._mapped(symbols, apart, first, end, begin, forced)
        return np.add.reduceat(counts, np.searchsorted(first, starts[:-1])), int(last_state)

    @staticmethod
    def _cuts(apart: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First places of all chunks: text starts, and every ``CHUNK`` the next place no token crosses."""
        wanted = np.arange(0, apart.size, CHUNK)
        free = np.flatnonzero(apart)
        k = np.searchsorted(free, wanted)
        near = free[np.minimum(k, free.size - 1)] if free.size else wanted
        snapped = np.where((near >= wanted) & (near - wanted < SNAP), near, wanted)
        return np.unique(np.concatenate([starts[:-1], snapped]))

    def _mapped(self, symbols, apart, first, end, begin, forced) -> tuple[np.ndarray, int]:
        """Counts of all chunks where some need a state map, and the last exit state."""
        n = first.size
        lanes, entries = [np.flatnonzero(~forced)], [begin[~forced]]
        inside = np.flatnonzero(forced)
        # Run up to each chunk from several places; a place before the chunk in front is too early.
        for k in range(STARTS):
            where = np.maximum(first[inside] - RUN_UP - k, first[inside - 1])
            state, _ = self._run(symbols, apart, where, first[inside], np.zeros(inside.size, np.int64))
            lanes.append(inside)
            entries.append(state)
        lane, entry = np.unique(np.stack([np.concatenate(lanes), np.concatenate(entries)]), axis=1)
        exits, counts = self._run(symbols, apart, first[lane], end[lane], entry)
        into, out = _table(n, lane, np.where(forced[lane], entry, _ANY), exits)
        arrived = np.concatenate([[_ANY], _scan(into, out)[:-1]])
        chosen = np.where(forced, arrived, begin)
        found = {(int(a), int(b)): (int(x), int(c)) for a, b, x, c in zip(lane, entry, exits, counts)}
        last, total = 0, np.empty(n, np.int64)
        for i in range(n):
            # Where the scan met a state outside a map, the state is carried on one by one until maps hold it.
            state = int(chosen[i]) if chosen[i] != _MISS else last
            if (i, state) not in found:
                x, c = self._run(symbols, apart, first[i : i + 1], end[i : i + 1], np.array([state]))
                found[i, state] = int(x[0]), int(c[0])
            last, total[i] = found[i, state]
        return total, last


def _table(n: int, lane: np.ndarray, entry: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State maps as two tables, a row for each chunk: entry states and their exit states."""
    order = np.argsort(lane, kind="stable")
    place = np.arange(lane.size) - np.searchsorted(lane[order], lane[order])
    wide = int(place.max(initial=0)) + 1
    into, out = np.full((n, wide), _NONE, np.int64), np.full((n, wide), _MISS, np.int64)
    into[lane[order], place], out[lane[order], place] = entry[order], exits[order]
    return into, out


def _scan(into: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Exit state after each chunk, by composing neighbouring maps over doubling distances."""
    base_in, base_out = into.copy(), out.copy()
    # A row's composed map: its own entries stay those of the first chunk it covers.
    now_in, now_out, step = base_in, base_out, 1
    while step < into.shape[0]:
        left_in, left_out = now_in[:-step], now_out[:-step]
        right_in, right_out = now_in[step:], now_out[step:]
        fixed = right_in[:, 0] == _ANY
        same = right_in[:, None, :] == left_out[:, :, None]
        hit = same.any(2)
        got = np.take_along_axis(right_out, same.argmax(2), 1)
        joined_in = np.where(fixed[:, None], right_in, left_in)
        joined_out = np.where(fixed[:, None], right_out, np.where(hit & (left_in != _NONE), got, _MISS))
        now_in = np.concatenate([now_in[:step], joined_in])
        now_out = np.concatenate([now_out[:step], joined_out])
        step *= 2
    return np.where(now_in[:, 0] == _ANY, now_out[:, 0], _MISS)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as the model at ``path`` would count them.

    Null texts count as empty, and empty texts have no tokens. Special strings inside texts are text.
    Each row is counted by itself, so repeated rows and null ids stay as they are; other columns are not read.
    An empty table gives an empty table. A very long text is counted in segments of 4,000,000 characters that
    pass their state on.
    """
    vocabulary = read_vocabulary(path)

    def count(batch: pa.RecordBatch) -> dict:
        machine = _loaded.get(path)
        if machine is None:
            machine = _loaded[path] = Transducer(vocabulary)
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "n_tokens": machine.count(batch.column("text").to_pylist()),
        }

    rows = texts(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = map_rows(rows, count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
