"""Byte-level BPE encoding and decoding with a rank file (operator 2).

Pre-tokens are merged with a rank queue: one bucket per merge rank holds the positions of the linked list where a
pair of that rank starts, a hierarchical bitmap marks the buckets in use, and find-first-set picks the lowest rank.
A merge leaves old entries behind; they are skipped when popped because the pair at that place has another rank by
then.  A pre-token of n bytes costs n log n steps, so megabytes without a space are no problem.

Short pre-tokens of a batch share one queue: their linked lists lie behind one another in one array, and a bucket is
drained for all of them at once, the leftmost entry of each.  Long ones have a queue of their own.

Defined results: a null text encodes like the empty text, to no ids; null ids decode to the empty byte string; an id
without a token raises.  Every row is its own unit of work: repeated rows and long texts need no special case."""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 20        # characters of a text that are split at once
LONG_PIECE = 64          # bytes; from here on a pre-token has a queue of its own
PART = 12 << 20           # bytes of a batch whose pre-tokens share a queue
REMEMBERED = 1 << 17     # pre-tokens a worker keeps from part to part
FORGOTTEN_AFTER = 64     # parts, so that memory follows the texts
END = (".", ",")
GATHERED = 1 << 20       # entries whose bytes are gathered at once
# white space of any script before a space
SPACE_BEHIND_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
BLANK_BEFORE_SPACE = re.compile(r"\s ")
AFTER_INK = re.compile(r"(?<=\S)(?= )")
BITS = [1 << i for i in range(256)]


class Bitmap:
    """Ranks in use, in two levels; ``first`` is the lowest."""

    def __init__(self, n: int):
        self.leaves, self.used = [0] * ((n >> 8) + 1), 0

    def add(self, rank: int) -> None:
        self.leaves[rank >> 8] |= BITS[rank & 255]
        self.used |= 1 << (rank >> 8)

    def first(self) -> int:
        high = (self.used & -self.used).bit_length() - 1
        word = self.leaves[high]
        return (high << 8) + (word & -word).bit_length() - 1

    def drop_first(self) -> None:
        high = (self.used & -self.used).bit_length() - 1
        self.leaves[high] &= self.leaves[high] - 1
        if not self.leaves[high]:
            self.used &= self.used - 1


class Vocabulary:
    """Ranks of a rank file (base64 token and number a line) and the pattern of its pre-tokens."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.n = max(self.ranks.values(), default=-1) + 1
        self.split = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.lengths = np.zeros(self.n, np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = rank
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)] or [-1], np.int32)
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.pieces: dict[str, bytes] = {}
        self.parts = 0
        self.table: bytes | None = None
        # may words of plain letters be told apart from a full stop or comma without a search?
        self.plain = [self.split.findall(x) for x in (" ab", " ab.", " ab,")] == [[" ab"], [" ab", "."], [" ab", ","]]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, by a queue of its own."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        rank_of, bitmap, buckets = ranks.get, Bitmap(self.n), {}
        n = len(piece)
        after = list(range(1, n + 1))   # where the symbol that starts here ends, which is where the next starts
        before = list(range(-1, n - 1))
        pair = [-1] * n                 # rank of the pair that starts here

        def push(rank: int, at: int) -> None:
            pair[at] = rank
            if rank in buckets:
                heappush(buckets[rank], at)
            elif rank >= 0:
                buckets[rank] = [at]
                bitmap.add(rank)

        for i in range(n - 1):
            push(rank_of(piece[i:i + 2], -1), i)
        while bitmap.used:
            rank = bitmap.first()
            i = heappop(buckets[rank])
            if not buckets[rank]:
                del buckets[rank]
                bitmap.drop_first()
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = pair[i] = -1
            if k < n:
                before[k] = i
                push(rank_of(piece[i:after[k]], -1), i)
            if (h := before[i]) >= 0:
                push(rank_of(piece[h:k], -1), h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], np.int32(-1))

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, by one queue for all; in each round the leftmost pair of the lowest rank in
        every piece is merged, as if each had been alone."""
        text = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        n, owner = len(text), np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        symbol = self.bytes[text]
        if n and symbol.min() < 0:
            raise ValueError("the rank file lacks single bytes of the text")
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1] = n             # the end of a piece is a wall
        before[ends - sizes] = -1
        pair = np.full(n + 1, -1, np.int32)
        inner = np.flatnonzero(after < n)
        pair[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        alive, bitmap, buckets = np.ones(n, bool), Bitmap(self.n), {}

        def push(at: np.ndarray) -> None:
            at = at[pair[at] >= 0]
            if not len(at):
                return
            rank = pair[at]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, some in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in buckets:
                    buckets[r].append(some)
                else:
                    buckets[r] = [some]
                    bitmap.add(r)

        push(inner)
        while bitmap.used:
            rank = bitmap.first()
            found = buckets[rank]
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.sort(at[pair[at] == rank])  # without the stale ones
            whose = owner[at]
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = whose[1:] != whose[:-1]
            if leftmost.all():
                del buckets[rank]
                bitmap.drop_first()
            else:
                buckets[rank] = [at[~leftmost]]
            i = at[leftmost]
            j = after[i]
            k = after[j]
            after[i], symbol[i], pair[i], pair[j], alive[j] = k, rank, -1, -1, False
            right = k < n
            before[k[right]] = i[right]
            pair[i[right]] = self._ranks(symbol[i[right]], symbol[k[right]])
            h = before[i]
            h = h[h >= 0]
            pair[h] = self._ranks(symbol[h], np.full(len(h), rank, np.int32))
            push(np.concatenate((i[right], h)))
        ids = symbol[alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(owner[alive], minlength=len(pieces))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, pieces: set[str]) -> None:
        """Have ``pieces`` hold all of these."""
        short = []
        for p in pieces:
            if p not in self.pieces:
                raw = p.encode()
                if raw in self.ranks:
                    self.pieces[p] = self.ranks[raw].to_bytes(4, "little")
                elif len(raw) >= LONG_PIECE:
                    self.pieces[p] = np.array(self.merge(raw), "<u4").tobytes()
                else:
                    short.append(p)
        self.pieces.update(zip(short, self.merge_many([p.encode() for p in short])))

    def _packed(self, names: list[str], whole: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of stretches, named without their leading space, and of strings as they are.  Words of plain letters,
        alone or before a full stop or comma, need no search."""
        alone, ended, rest = [], [], []
        for i, x in enumerate(names):
            kind = rest
            if self.plain and x.isascii():
                if x.isalpha():
                    kind = alone
                elif x[-1:] in END and x[:-1].isalpha():
                    kind = ended
            kind.append(i)
        words = [" " + names[i] for i in alone]
        stems = [" " + names[i][:-1] for i in ended]
        parts = list(map(self.split.findall, chain((" " + names[i] for i in rest), whole)))
        needed = set(words)
        needed.update(stems, END if ended else (), chain.from_iterable(parts))
        self._learn(needed)
        piece, out = self.pieces, [b""] * len(names)
        for i, x in zip(alone, words):
            out[i] = piece[x]
        for i, x in zip(ended, stems):
            out[i] = piece[x] + piece[names[i][-1]]
        found = [b"".join(map(piece.__getitem__, p)) for p in parts]
        for i, x in zip(rest, found):
            out[i] = x
        return out, found[len(rest):]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """The same from and to Arrow.

        No pre-token has a space after another character than white space.  Texts can therefore be taken apart
        there, and the stretches between, mostly a word with its punctuation, be looked up whole.  A batch is split and
        its different stretches numbered by Arrow; only these are merged, and the ids of all texts are gathered by
        number.  A stretch is named without its leading space; the start of a text, which has none, is kept apart.
        Texts with a space behind white space are taken apart one by one."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, at = [], 0
        while at < len(texts):
            most = (ends[at - 1] if at else 0) + PART
            end = max(at + 1, int(np.searchsorted(ends, most, side="right")))
            parts.append(self._encode_part(texts.slice(at, end - at)))
            at = end
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _encode_part(self, texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, SPACE_BEHIND_BLANK)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first -= first[0]
        names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()   # much faster than to_pylist
        numbers = numbered.indices.to_numpy().copy()
        heads = [names[i] for i in numbers[first[:-1]].tolist()]
        # heads, and whole texts with odd spaces, are numbered behind the stretches
        numbers[first[:-1]] = np.arange(len(names), len(names) + len(texts))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        apart = [[y for h, x in _taken_apart(text) for y in (h, *(" " + z for z in x))] for text in texts.filter(odd).to_pylist()]
        entries, more = self._packed(names, [*heads, *chain.from_iterable(apart)])
        starts, rest = more[:len(heads)], iter(more[len(heads):])
        for i, x in zip(at, apart):
            starts[i] = b"".join(islice(rest, len(x)))
        entries += starts
        self._forget()
        return _gathered(b"".join(entries), np.fromiter(map(len, entries), np.int64, len(entries)), numbers, first, 4)

    def _forget(self) -> None:
        """Keep the pre-tokens met first, among which are the frequent ones."""
        self.parts += 1
        if self.parts % FORGOTTEN_AFTER == 0:
            self.pieces.clear()
        elif len(self.pieces) > REMEMBERED:
            self.pieces = dict(islice(self.pieces.items(), REMEMBERED))

    def decode(self, ids: bytes | None) -> bytes:
        return self.decode_array(pa.array([ids], pa.binary()))[0].as_py()

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """Bytes of packed ids, gathered from one table of all tokens."""
        if self.table is None:
            tokens = [self.tokens.get(i, b"") for i in range(self.n)]
            self.table = b"".join(tokens)
        ids, parts, at = pc.fill_null(ids, b""), [], 0
        ends = np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
            some = ids.slice(at, end - at)
            numbers = np.frombuffer(b"".join(some.to_pylist()), "<u4")
            if len(numbers) and (numbers.max() >= self.n or not self.lengths[numbers].all()):
                raise KeyError("an id without a token")
            first = np.concatenate(([0], (ends[at:end] - (ends[at - 1] if at else 0)) >> 2))
            parts.append(_gathered(self.table, self.lengths, numbers, first, 1))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _gathered(table: bytes, sizes: np.ndarray, numbers: np.ndarray, first: np.ndarray, width: int) -> pa.Array:
    """Byte strings: row r is the entries ``numbers[first[r]:first[r + 1]]`` of the table behind one another.  All
    entries have a multiple of ``width`` bytes."""
    kind = np.uint32 if width == 4 else np.uint8
    units = sizes // width
    starts = np.cumsum(units) - units
    n = units.take(numbers)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, kind)
    source, whole = np.frombuffer(table, kind), np.concatenate(([0], ends))
    for a in range(0, len(numbers), GATHERED):   # bounds the size of the positions
        b = min(a + GATHERED, len(numbers))
        some = n[a:b]
        at = np.arange(whole[b] - whole[a]) + np.repeat(starts.take(numbers[a:b]) - (whole[a:b] - whole[a]), some)
        out[whole[a]:whole[b]] = source.take(at)
    offsets = whole.take(first) * width
    if offsets[-1] >= 1 << 31:
        raw = out.tobytes()
        return pa.array([raw[a:b] for a, b in zip(offsets.tolist(), offsets.tolist()[1:])], pa.large_binary()).cast(pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _taken_apart(text: str):
    """Segments of a text as (start without a leading space or nothing, stretches that follow a space)."""
    at = 0
    while at < len(text):
        cut = AFTER_INK.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        segment = text[at:cut.start()] if cut else text[at:]
        at += len(segment)
        if BLANK_BEFORE_SPACE.search(segment):
            for x in AFTER_INK.split(segment):
                yield ("", [x[1:]]) if x[0] == " " else (x, [])
        else:
            head, *stretches = segment.split(" ")
            yield head, stretches


class Tokenizer:
    """Column functions for one rank file.  The file is read by the driver and broadcast: it is as large as its
    vocabulary, whatever the data.  A worker keeps what it builds of it beside the broadcast value, from task to task."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.shared = spark.sparkContext.broadcast({"content": Path(path).read_bytes(), "pattern": pattern})

    def vocabulary(self) -> Vocabulary:
        """In a task: the vocabulary, built once per worker."""
        shared = self.shared.value
        if "built" not in shared:
            shared["built"] = Vocabulary(shared["content"], shared["pattern"])
        return shared["built"]

    def encode_packed(self, text: Column) -> Column:
        """Ids as binary, four bytes each: half the width of an array on the way to the next step."""
        of = self.vocabulary

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            return of().encode_array(texts)

        return encode(text)

    def encode(self, text: Column) -> Column:
        """Ids as array<int>."""
        of = self.vocabulary

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            packed = of().encode(texts.to_pylist())
            ends = np.cumsum([0, *(len(p) >> 2 for p in packed)]).astype(np.int32)
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))

        return encode(text)

    def decode_packed(self, ids: Column) -> Column:
        """Bytes of packed ids."""
        of = self.vocabulary

        @F.arrow_udf("binary")
        def decode(column: pa.Array) -> pa.Array:
            return of().decode_array(column)

        return decode(ids)

    def decode(self, ids: Column) -> Column:
        """Bytes of array<int> ids; cast to string where they are whole characters."""
        of = self.vocabulary

        @F.arrow_udf("binary")
        def decode(column: pa.Array) -> pa.Array:
            tokens = of().tokens
            return pa.array([b"".join(map(tokens.__getitem__, chain(x.as_py() or ()))) for x in column], pa.binary())

        return decode(ids)
