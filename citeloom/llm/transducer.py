"""Token counts by a compiled finite-state tokenizer (operator 9).

The tokenizer is compiled, as it is used, into a deterministic transducer over
bytes whose transitions carry the change in the number of tokens. A symbol is a
byte and a mark that says whether a pre-token starts there.

States. After a prefix of a pre-token, what is to come depends only on the
places where a vocabulary entry may still be growing: for each of them, the
bytes since, the last token of the encoding up to there and how many tokens
that encoding has relative to the prefix's own. A transition appends a byte,
finds the one entry that ends there and is compatible with the last token
before it (two tokens are if the pair encodes to itself), and drops the places
no entry reaches past. Weights can be negative: a byte may merge what stood
apart. Only transitions that occur are built; the table is bounded, and
rebuilt from the states in use when full.

Running. A batch of texts is laid end to end and cut into chunks of equal
size. All chunks advance together, one byte a step. The map of a chunk, from
the state it is entered with to the state it is left with and the tokens
counted, is constant from its first pre-token on. A chunk inside one long
pre-token has a map of its own: it is run from a guessed state and from the
states that the chunk before may be left with, until no new ones come up (BPE
forgets quickly, so that is two rounds; chunks of like bytes share their map).
A parallel prefix scan then composes the maps by doubling and tells the state
that each chunk is really entered with, and the bytes before a chunk's first
pre-token are run from there. Texts that never settle go on chunk by chunk.

A text longer than a batch runs in slices that hand on their state, so memory
doesn't grow with the text.

Pre-token starts follow from the classes of neighbouring characters, computed
for the whole batch at once.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.bpe import read_vocabulary
from citeloom.llm.common import text_of
from citeloom.llm.hf import byte_level_spec

CHUNK = 256
BATCH_BYTES = 2 << 20
MOST_STATES = 1 << 17
#: Code points that a pre-token's start can depend on, on either side.
NEAR = 4
#: Rounds in which chunks inside one pre-token find their states.
ROUNDS = 24
_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of every code point, by the pattern engine's own categories."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            codes = np.frombuffer(m[0].encode("utf-32-le"), "<u4")
            out[codes] = kind
    return out


class Transducer:
    """A byte-level BPE with the ByteLevel pre-tokeniser, compiled as it runs."""

    def __init__(self, data: bytes):
        if (spec := byte_level_spec(data)) is None:
            raise ValueError("only byte-level BPE vocabularies compile to a transducer")
        added, vocab, merges = spec
        # Entries are numbered by age: bytes first, then merges in their order.
        self.age = {bytes([b]): b for b in range(256)}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves = [(b, b) for b in range(256)]
        for left, right in merges:
            a, b = self.age[left], self.age[right]
            made = self.age.setdefault(left + right, len(self.halves))
            if made == len(self.halves):
                self.halves.append((a, b))
            self.joined.setdefault((a, b), made)
        if len(self.age) != len(vocab) or len(self.halves) != len(vocab):
            raise ValueError("every entry must come from one merge")
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")
        self.growing = {t[:i] for t in vocab for i in range(len(t))}  # proper prefixes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.classes = _classes()
        self.most = MOST_STATES
        self._empty()

    # -- compiling -----------------------------------------------------------

    def _empty(self) -> None:
        # A cell holds (next state + 1) << 8 | (weight + 128); 0 is not built yet.
        self.table = np.zeros((self.most, 256), np.uint32)
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.start = self._state(((0, None, 0),), b"")

    def _state(self, alive: tuple, tail: bytes) -> int:
        key = (tail, alive)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        return self.number[key]

    def _encode(self, text: bytes) -> list[int]:
        """The encoding of an entry's bytes, merge by merge."""
        ids = list(text)
        while made := [m for p in zip(ids, ids[1:], strict=False) if (m := self.joined.get(p)) is not None]:
            first = next(i for i, p in enumerate(zip(ids, ids[1:], strict=False)) if self.joined.get(p) == min(made))
            ids[first : first + 2] = [min(made)]
        return ids

    def _fits(self, left: int, right: int) -> bool:
        """Whether two entries side by side stay apart when encoded.

        Goes back in time: the younger of the entries at the border is undone,
        and what then touches must not have a merge older than that.
        """
        a, b, undone = left, right, len(self.halves)
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < undone:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                undone, a = a, self.halves[a][1]
            else:  # merges of one age go from the left, so an equal one on the right comes later
                undone, b = b + 1, self.halves[b][0]

    def _build(self, state: int, byte: int) -> None:
        tail, alive = self.states[state]
        tail += bytes([byte])
        n, age, pairs = len(tail) - 1, self.age, self.pairs
        token, weight, grown = -1, 0, []
        for size, last, relative in alive:
            since = tail[n - size :]
            if token < 0 and (entry := age.get(since)) is not None:
                if last is None:
                    if (fits := self.whole.get(entry)) is None:
                        fits = self.whole[entry] = self._encode(since) == [entry]
                elif (fits := pairs.get((last, entry))) is None:
                    fits = pairs[last, entry] = self._fits(last, entry)
                if fits:
                    token, weight = entry, relative + 1
            if since in self.growing:
                grown.append((size + 1, last, relative))
        if token < 0:
            raise AssertionError("every byte is an entry, so one ends here")
        if len(pairs) > 1_000_000:
            pairs.clear()
        kept = tuple([(size, last, relative - weight) for size, last, relative in grown]) + ((0, token, 0),)
        to = self._state(kept, tail[len(tail) - kept[0][0] :] if kept[0][0] else b"")
        self.table[state, byte] = (to + 1) << 8 | (weight + 128)

    def _advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.table[state, byte]
        if not cell.all():
            lacking = np.nonzero(cell == 0)[0]
            wanted = np.unique(state[lacking].astype(np.int64) << 8 | byte[lacking])
            for w in wanted.tolist():
                self._build(w >> 8, w & 255)
            cell = self.table[state, byte]
        return (cell >> 8).astype(np.int64) - 1, (cell & 255).astype(np.int64) - 128

    def _room(self, *held: np.ndarray) -> None:
        """Empty a nearly full table, keeping the states in use (in place); a larger one if these fill it."""
        if len(self.states) < self.most - self.most // 4:
            return
        used = np.unique(np.concatenate([h[h >= 0].ravel() for h in held]))
        old = self.states
        self.most = max(self.most, 4 * len(used))
        self._empty()
        new = np.zeros(len(old), np.int64)
        for s in used.tolist():
            new[s] = self._state(old[s][1], old[s][0])
        for h in held:
            h[h >= 0] = new[h[h >= 0]]

    # -- running -------------------------------------------------------------

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which code points begin a pre-token; first marks the texts' first ones."""
        n = len(codes)
        kind = self.classes[codes]
        before = np.concatenate([[_OTHER], kind[:-1]]).astype(np.uint8)
        prior = np.concatenate([[0], codes[:-1]])
        last = np.concatenate([first[1:], [True]])
        blank = kind == _BLANK
        out = first | (~blank & (kind != before) & (prior != 32))
        # A run of blanks begins a piece; its last blank, if text follows, another.
        runs_on = np.concatenate([blank[1:], [False]]) & ~last
        out |= blank & (before != _BLANK)
        out |= blank & ~runs_on & ~last
        # Contractions: an apostrophe where a piece begins, and what it takes along.
        quote = np.nonzero((codes == 39) & (first | (before != _OTHER)) & ~((prior == 32) & ~first))[0]
        if len(quote):
            ends = np.nonzero(last)[0]
            room = ends[np.searchsorted(ends, quote)] - quote
            near = lambda d: np.where(room >= d, codes[np.minimum(quote + d, n - 1)], 0)
            one, two = near(1), near(2)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long_ = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for where, size in ((quote[short], 2), (quote[long_], 3)):
                out[where] = True
                out[where + 1] = False
                after = where + size
                inside = ~np.concatenate([last, [True]])[after - 1]
                after = after[inside]
                # A blank after it begins a piece by the rules above.
                out[after[kind[after] != _BLANK]] = True
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text as the library counts them without special tokens."""
        totals = np.zeros(len(texts), np.int64)
        owner, parts = [], []
        for i, text in enumerate(texts):
            if self.added.search(text):
                totals[i] += len(self.added.findall(text))
                pieces = [p for p in self.added.split(text) if p]
            else:
                pieces = [text] if text else []
            owner += [i] * len(pieces)
            parts += pieces
        at = 0
        while at < len(parts):
            end, held = at + 1, len(parts[at])
            while end < len(parts) and held + len(parts[end]) <= BATCH_BYTES // 2:
                held += len(parts[end])
                end += 1
            if end == at + 1 and held > BATCH_BYTES // 2:
                totals[owner[at]] += self._count_long(parts[at])
            else:
                np.add.at(totals, np.array(owner[at:end]), self._count(parts[at:end]))
            at = end
        return totals

    def _marks(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code point's bytes begin, and the bytes that begin a pre-token."""
        width = (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).astype(np.int64)
        offset = np.cumsum(width) - width
        mark = np.zeros(int(width.sum()), bool)
        mark[offset[self.starts(codes, first)]] = True
        return offset, mark

    def _count(self, parts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        lengths = np.array([len(p) for p in parts])
        begin = np.cumsum(lengths) - lengths
        first = np.zeros(len(codes), bool)
        first[begin] = True
        offset, mark = self._marks(codes, first)
        data = np.frombuffer("".join(parts).encode(), np.uint8)
        weight, _ = self.run(data, mark, self.start)
        sums = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
        ends = np.concatenate([offset[begin[1:]], [len(data)]])
        return sums[ends] - sums[offset[begin]]

    def _count_long(self, text: str) -> int:
        """Slice by slice, each with a few code points more to tell pre-token starts by."""
        total, state, size = 0, self.start, BATCH_BYTES // 4
        for at in range(0, len(text), size):
            low, high = max(0, at - NEAR), min(len(text), at + size)
            codes = np.frombuffer(text[low : high + NEAR].encode("utf-32-le"), "<u4")
            first = np.zeros(len(codes), bool)
            first[0] = low == 0
            offset, mark = self._marks(codes, first)
            data = np.frombuffer(text[at:high].encode(), np.uint8)
            begin = int(offset[at - low])
            weight, state = self.run(data, mark[begin : begin + len(data)], state)
            total += int(weight.sum(dtype=np.int64))
        return total

    def run(self, data: np.ndarray, mark: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Weights by byte and the state at the end; mark says where pre-tokens start.

        Weights up to a chunk's first start are summed at the chunk's first byte.
        """
        n = len(data)
        chunks = -(-n // CHUNK)
        padded = chunks * CHUNK
        sym = np.zeros(padded, np.uint8)
        sym[:n] = data
        cut = np.zeros(padded, bool)
        cut[:n] = mark
        rows = sym.reshape(chunks, CHUNK)
        sym, cut = np.ascontiguousarray(rows.T), np.ascontiguousarray(cut.reshape(chunks, CHUNK).T)
        size = np.full(chunks, CHUNK)
        size[-1] = n - (chunks - 1) * CHUNK
        weight = np.zeros((CHUNK, chunks), np.int32)
        head = np.where(cut.any(0), cut.argmax(0), size)
        state, given = np.full(chunks, -1, np.int64), np.array([entry])
        for t in range(CHUNK):
            self._room(state, given)
            state[cut[t]] = self.start
            on = np.nonzero((state >= 0) & (t < size))[0]
            if len(on):
                state[on], weight[t, on] = self._advance(state[on], sym[t, on])
        open_ = np.nonzero(state < 0)[0]
        if len(open_):
            state[open_], weight[0, open_] = self._through(rows, sym, size, open_, state, given)
        # What stands before a chunk's first start, from the state it is entered with.
        lanes = np.nonzero((head > 0) & cut.any(0))[0]
        if len(lanes):
            _, total = self._lanes(sym, lanes, np.where(lanes > 0, state[lanes - 1], given[0]), head[lanes], state, given)
            weight[0, lanes] = total
        return weight.T.reshape(-1)[:n], int(state[-1])

    def _lanes(self, sym: np.ndarray, chunk: np.ndarray, entry: np.ndarray, stop: np.ndarray, *held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and total weights after the first ``stop`` bytes of chunks."""
        state, total = entry.astype(np.int64), np.zeros(len(entry), np.int64)
        for t in range(int(stop.max())):
            self._room(state, *held)
            on = np.nonzero(stop > t)[0]
            state[on], w = self._advance(state[on], sym[t, chunk[on]])
            total[on] += w
        return state, total

    def _through(self, rows: np.ndarray, sym: np.ndarray, size: np.ndarray, open_: np.ndarray, state: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and weights of the chunks that lie inside one pre-token."""
        m = len(open_)
        lead = np.concatenate([[True], np.diff(open_) > 1])  # the chunk before has a known state
        _, like = np.unique(np.column_stack([rows[open_], size[open_] == CHUNK]), axis=0, return_inverse=True)
        like = like.reshape(-1)
        before = lambda: np.where(open_ > 0, state[open_ - 1], given[0])
        enter = np.where(lead, before(), self.start)[:, None]
        leave, total = np.full((m, 1), -1, np.int64), np.zeros((m, 1), np.int64)
        for _ in range(ROUNDS):
            # Run what has not been run, chunks of like bytes and state once.
            r, k = np.nonzero((enter >= 0) & (leave < 0))
            _, one, same = np.unique(np.column_stack([like[r], enter[r, k]]), axis=0, return_index=True, return_inverse=True)
            got, w = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
            got[:] = -1
            for at in range(0, len(one), 4096):
                lane = one[at : at + 4096]
                got[at : at + 4096], w[at : at + 4096] = self._lanes(sym, open_[r[lane]], enter[r[lane], k[lane]], size[open_[r[lane]]], state, given, enter, leave, got)
            leave[r, k], total[r, k] = got[same.reshape(-1)], w[same.reshape(-1)]
            # A state that the chunk before may be left with is one to be entered with.
            fresh = [np.where(~lead & (prior >= 0) & (enter != prior[:, None]).all(1), prior, -1) for prior in np.concatenate([np.full((1, leave.shape[1]), -1), leave[:-1]]).T]
            more = [f for f in fresh if (f >= 0).any()]
            if not more:
                break
            extra = np.full((m, len(more)), -1, np.int64)
            for c, f in enumerate(more):
                known = (extra == f[:, None]).any(1)
                extra[:, c] = np.where(known, -1, f)
            enter = np.concatenate([enter, extra], 1)
            leave, total = (np.concatenate([x, np.full(extra.shape, fill, np.int64)], 1) for x, fill in ((leave, -1), (total, 0)))
        else:
            return self._one_by_one(sym, size, open_, lead, before(), state, given)
        # Maps between the places of states in neighbouring chunks' lists, composed by doubling.
        prior = np.concatenate([np.zeros((1, leave.shape[1]), np.int64), leave[:-1]])
        maps = (enter[:, None, :] == prior[:, :, None]).argmax(2) if m * leave.shape[1] ** 2 < 1 << 24 else np.stack([(enter == prior[:, j, None]).argmax(1) for j in range(leave.shape[1])], 1)
        maps[lead] = 0
        step = 1
        while step < m:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
            step *= 2
        at = maps[:, 0]
        return leave[np.arange(m), at], total[np.arange(m), at]

    def _one_by_one(self, sym: np.ndarray, size: np.ndarray, open_: np.ndarray, lead: np.ndarray, entry: np.ndarray, state: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _through, along each pre-token's chunks in order."""
        total, now = np.zeros(len(open_), np.int64), np.nonzero(lead)[0]
        leave = np.full(len(open_), -1, np.int64)
        enter = entry[now].astype(np.int64)
        while len(now):
            out, total[now] = self._lanes(sym, open_[now], enter, size[open_[now]], state, given, leave)
            leave[now] = out
            goes = (now + 1 < len(open_)) & ~lead[np.minimum(now + 1, len(open_) - 1)]
            now, enter = now[goes] + 1, out[goes]
        return leave, total


_LOADED: dict[str, Transducer] = {}


def transducer(digest: str, data: bytes) -> Transducer:
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Transducer(data)
    return _LOADED[digest]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row; null counts as empty."""
    digest, data = read_vocabulary(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        machine = transducer(digest, sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(machine.count(texts), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
