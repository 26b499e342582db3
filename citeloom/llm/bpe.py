"""Byte-level BPE encoding and decoding (operator 1).

Each pre-token is encoded over a segment tree whose leaves are byte positions.
A leaf holds the rank of the pair that starts at its position, an inner node
the smaller key of its children, and the key is ``rank * width + position`` so
that the root is the leftmost pair of minimal rank. A merge changes three
leaves (the merged part, its left neighbour and the part that vanished), each
in a logarithmic number of steps.

Two forms of that tree are kept. Short pre-tokens that miss the cache are
encoded together, one lane per pre-token, with the tree laid out as a NumPy
matrix; long ones get a tree of their own, so that a text that is one
pre-token of a megabyte costs n log n and no more.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.llm.common import slices, text_of

#: Pre-tokens of at most this many bytes share a vectorised tree.
LANE_BYTES = 64
#: Bounds of the per-process cache of pre-tokens: entries of a generation, characters of a key.
CACHE_PIECES = 200_000
CACHE_CHARS = 48
ROWS_AT_ONCE = 256

_NONE = np.int32(1 << 24)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token and rank on each line."""
    out = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class SegmentTree:
    """Leftmost minimum over mutable keys; None of them left reads as _NONE."""

    def __init__(self, keys: list[int], none: int):
        size = 1
        while size < len(keys):
            size *= 2
        self.size, self.none = size, none
        self.tree = tree = [none] * size + keys + [none] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

    def put(self, at: int, key: int) -> None:
        tree, at = self.tree, at + self.size
        tree[at] = key
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                return
            tree[at] = least

    def least(self) -> int:
        return self.tree[1]


def quick_pattern(pattern: str) -> tuple:
    """The pattern in the re module's classes, which scan faster, and what it can't be used on.

    re has no \\p classes: its letters, digits and blanks differ from the
    pattern's on some characters. A text that holds any of those is left to
    the pattern itself, as is every text of a pattern with other classes.
    """
    quick = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in quick or re.search(r"\[[^\]]*\[", quick):
        return regex.compile(pattern), re.compile(r"(?!)")
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    differ: set[str] = set()
    for own, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s")):
        differ |= set(re.findall(own, every)).symmetric_difference(regex.findall(theirs, every))
    return re.compile(quick), re.compile("[" + "".join(map(re.escape, sorted(differ))) + "\U00010000-\U0010ffff]")


class Memo(dict):
    """A bounded cache in two generations that gathers the keys it lacks.

    A full cache becomes the old generation; what is looked up there moves
    into the new one, so words in use outlive the ones seen once.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.pending = most, {}, {}

    def __missing__(self, key: str) -> bytes | bytearray:
        known = self.old.get(key)
        if known is None:  # a place to be filled once all new keys are known
            known = self.pending[key] = bytearray()
        self[key] = known
        return known

    def joined(self, keys: list[list[str]], learn) -> list[bytes]:
        """The values of each list of keys, joined; learn(new keys) gives theirs."""
        self.pending = {}
        found = [list(map(self.__getitem__, k)) for k in keys]
        for key, value in learn(self.pending):
            self.pending[key] += value
            self[key] = value
        out = [b"".join(f) for f in found]
        for key in self.pending:
            if len(key) > CACHE_CHARS:
                del self[key]
        self.pending = {}
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return out


class Bpe:
    """A byte-level BPE vocabulary with cached pre-tokens."""

    def __init__(self, vocabulary: dict[bytes, int], pairs: dict[tuple[int, int], int], made: list[int], whole: bool, pattern: str):
        """pairs: rank of each pair of ids that merges; made: the id a rank makes.

        whole: a pre-token that is a vocabulary entry is that entry, whatever
        the merges make of it.
        """
        self.vocabulary, self.pairs, self.whole = vocabulary, pairs, vocabulary if whole else {}
        self.pattern = regex.compile(pattern)
        self.token_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = token
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        self.byte_id = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        self.made = np.array([*made, 0], np.int32)
        self._hash_pairs()
        self.pieces = Memo(CACHE_PIECES)
        self.quick, self.odd = quick_pattern(pattern)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int], pattern: str) -> Bpe:
        """Of a rank file: any two entries whose bytes make a third merge into it."""
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        return cls(ranks, pairs, list(range(max(ranks.values(), default=-1) + 1)), True, pattern)

    @classmethod
    def from_merges(cls, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str) -> Bpe:
        """Of a list of merges, the earliest first."""
        pairs: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            pairs.setdefault((vocabulary[left], vocabulary[right]), rank)
        return cls(vocabulary, pairs, [vocabulary[a + b] for a, b in merges], False, pattern)

    # -- one pre-token -----------------------------------------------------

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by a tree of its own."""
        n, rank_of, made = len(piece), self.pairs.get, self.made.tolist()
        width = 1
        while width < n + 1:
            width *= 2
        none = width << 34
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            j = after[i]
            rank = rank_of((ids[i], ids[j])) if j < n else None
            return none if rank is None else rank * width + i

        tree = SegmentTree([key(i) for i in range(n)], none)
        while (least := tree.least()) < none:
            i = least & (width - 1)
            j = after[i]
            ids[i] = made[least // width]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            tree.put(j, none)
            tree.put(i, key(i))
            if (left := before[i]) >= 0:
                tree.put(left, key(left))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    # -- many short pre-tokens ---------------------------------------------

    def _hash_pairs(self) -> None:
        """An open-addressed table of the pairs that merge, filled in rounds.

        A cell holds the pair's key, shifted, and its rank; -1 is empty.
        """
        keys = np.array([a << 22 | b for a, b in self.pairs], np.int64)
        ranks = np.array(list(self.pairs.values()), np.int64)
        self.bits = max(10, 3 + len(keys).bit_length())
        self.cells = np.full(1 << self.bits, -1, np.int64)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            at = (self._slot(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = self.cells[at] == -1
            self.cells[at[free]] = keys[left[free]] << 20 | ranks[left[free]]
            left, self.probes = left[self.cells[at] >> 20 != keys[left]], self.probes + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        key = left.astype(np.int64) << 22 | right
        at = self._slot(key)
        cell = self.cells[at]
        out = np.where(cell >> 20 == key, cell & 0xFFFFF, _NONE).astype(np.int32)
        go = np.nonzero((cell >> 20 != key) & (cell != -1))[0]
        while len(go):
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            cell = self.cells[at[go]]
            hit = cell >> 20 == key[go]
            out[go[hit]] = cell[hit] & 0xFFFFF
            go = go[~hit & (cell != -1)]
        return out

    def encode_lanes(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of at most LANE_BYTES bytes, a tree row for each."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        width = 4
        while width <= LANE_BYTES:
            low = 0 if width == 4 else width // 2
            lanes = np.nonzero((sizes > low) & (sizes <= width))[0]
            if len(lanes):
                for lane, ids in zip(lanes, self._lanes([pieces[i] for i in lanes], sizes[lanes], width), strict=True):
                    out[lane] = ids
            width *= 2
        return out

    def _lanes(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        m = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(m, width)
        spots = np.arange(width, dtype=np.int32)
        ids = self.byte_id[raw].ravel()
        live = (spots[None, :] < sizes[:, None]).ravel()
        after = np.tile(spots + 1, m)
        before = np.tile(spots - 1, m)
        none = np.int32(_NONE * width) if width <= 64 else None
        base, end = np.arange(m) * width, sizes.astype(np.int32)
        pair = self._pair(ids[:-1], ids[1:])
        pair = np.append(pair, _NONE).reshape(m, width)[:, :-1]
        tree = np.full((m, 2 * width), none, np.int32)
        tree[:, width:-1] = np.where((pair < _NONE) & live.reshape(m, width)[:, 1:], pair * width + spots[:-1], none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat, stride = tree.ravel(), 2 * width

        def put(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
            root, node = rows * stride, at + width
            flat[root + node] = key
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                child = root + 2 * node
                flat[root + node] = np.minimum(flat[child], flat[child + 1])

        active = np.nonzero(tree[:, 1] < none)[0]
        while len(active):
            least = flat[active * stride + 1]
            i = least & (width - 1)
            here = base[active] + i
            j = after[here]
            k = after[base[active] + j]
            ids[here] = self.made[least // width]
            live[base[active] + j] = False
            after[here] = k
            inside = k < end[active]
            rows, at = active[inside], i[inside]
            right = base[rows] + k[inside]
            before[right] = at
            put(active, j, np.full(len(active), none, np.int32))
            key = np.full(len(active), none, np.int32)
            rank = self._pair(ids[here[inside]], ids[right])
            key[inside] = np.where(rank < _NONE, rank * width + at, none)
            put(active, i, key)
            left = before[here]
            has = left >= 0
            if has.any():
                rows, at = active[has], left[has]
                rank = self._pair(ids[base[rows] + at], ids[here[has]])
                put(rows, at, np.where(rank < _NONE, rank * width + at, none))
            active = active[flat[active * stride + 1] < none]
        out = ids[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.reshape(m, width).sum(1))).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    # -- texts ---------------------------------------------------------------

    def pretokens(self, text: str) -> list[str]:
        """The pattern's matches; most texts need only the re module's classes."""
        return (self.pattern if self.odd.search(text) else self.quick).findall(text)

    def _learn(self, pieces: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        short, raws = [], []
        for p in pieces:
            raw = p.encode()
            entry = self.whole.get(raw)
            if entry is not None:
                yield p, entry.to_bytes(4, "little")
            elif len(raw) <= LANE_BYTES:
                short.append(p)
                raws.append(raw)
            else:
                yield p, np.array(self.encode_long(raw), "<u4").tobytes()
        yield from zip(short, self.encode_lanes(raws), strict=True)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        return self.pieces.joined([self.pretokens(t) for t in texts], self._learn)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_LOADED: dict[str, Bpe] = {}


def bpe(digest: str, data: bytes, pattern: str) -> Bpe:
    """The vocabulary of a rank file, once for each process."""
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Bpe.from_ranks(load_ranks(data), pattern)
    return _LOADED[digest]


def read_vocabulary(path: str) -> tuple[str, bytes]:
    """A vocabulary file as the driver reads it; executors get its bytes."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), data


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts and decode the ids again.

    Returns (id_col, n_tokens long, ids binary, decoded binary); ids holds
    little-endian unsigned 32-bit numbers. The vocabulary file (a few MB,
    whatever the corpus) is read on the driver and broadcast. Null and empty
    texts give no ids; the plan has no shuffle.
    """
    return _over(docs, vocabulary, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like encode(), with digests in place of the ids and decoded bytes.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256
    over the decoded bytes.
    """
    return _over(docs, vocabulary, pattern, id_col, text_col, True)


def _over(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    digest, data = read_vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = T.StringType() if digests else T.BinaryType()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), *[T.StructField(n, kind) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small lists and no cycles
        model = bpe(digest, sent.value, pattern)
        decimal = model.decimal.__getitem__
        for batch in batches:
            for at, size in slices(batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, size)
                encoded = model.encode_texts(part.column("text").to_pylist())
                count, first, second = [], [], []
                for raw in encoded:
                    ids = np.frombuffer(raw, "<u4").tolist()
                    back = b"".join(map(model.token_bytes.__getitem__, ids))
                    count.append(len(ids))
                    first.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest() if digests else raw)
                    second.append(hashlib.sha256(back).hexdigest() if digests else back)
                arrow = pa.string() if digests else pa.binary()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count, pa.int64()), pa.array(first, arrow), pa.array(second, arrow)], ["id", "n_tokens", *names])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


__all__ = ["Bpe", "SegmentTree", "bpe", "encode", "encode_digests", "load_ranks", "read_vocabulary"]
