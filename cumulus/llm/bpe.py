"""Operator 1: byte-level BPE encoding and decoding.

Pre-tokenising uses no regular expression.  Every code point gets a symbol from
a class array (letter, number, white space, other; an apostrophe that opens a
contraction and a space that may lead a word are told apart by one or two code
points of lookahead).  A symbol is a transition function on eight token states.
The functions that compositions of these symbols can reach form a small finite
monoid, so a function is one byte and composing two is one table lookup: the
state before every code point comes from an associative scan over blocks of the
text, vectorised across blocks.  A boundary is where (state, symbol) starts a
token.  The slices between boundaries are looked up in a bounded cache; slices
that are missing are merged together, one vectorised merge round at a time.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values: the split pattern's white space and contractions --------------------
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER = "stmd"
TWO_LETTERS = ["re", "ve", "ll"]

# Symbols of code points, and token states.
LETTER, NUMBER, OTHER, SHORT, LONG, LEAD, LAST, SPACE = range(8)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_LEAD, IN_SPACE, ONE_TO_GO, TWO_TO_GO = range(8)

BLOCK = 512                 # code points a block of the scan
PART_BYTES = 1 << 20        # bytes of text scanned at once
BATCH_ROWS = 256            # texts encoded before their rows go back to Spark
CACHE_SLICES = 400_000      # slices kept by a worker before the cache starts anew
WIDE = 32                   # bytes of the longest slice merged in the vectorised rounds
NO_RANK = np.int32(1 << 30)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the symbol starts a token, after ``state``."""
    if symbol == LETTER:
        if state in (IN_LETTERS, AFTER_LEAD):
            return IN_LETTERS, False
        if state == TWO_TO_GO:
            return ONE_TO_GO, False
        if state == ONE_TO_GO:
            return CLOSED, False
        return IN_LETTERS, True
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_LEAD)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, AFTER_LEAD):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_TO_GO, LONG: TWO_TO_GO}[symbol], True
    if symbol == LEAD:
        return AFTER_LEAD, True
    if symbol == LAST:
        return CLOSED, True
    return IN_SPACE, state != IN_SPACE


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the sixteen generators (symbol, and symbol at the start of a text),
    the composition table, and every function's values on the states."""
    plain = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
    first = [tuple([_step(CLOSED, c)[0]] * 8) for c in range(8)]
    known: dict[tuple, int] = {tuple(range(8)): 0}
    todo = [*plain, *first]
    for f in todo:
        known.setdefault(f, len(known))
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for g in list(known):
                h = tuple(g[f[s]] for s in range(8))
                if h not in known:
                    known[h] = len(known)
                    grown = True
    functions = list(known)
    compose = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in functions] for f in functions],
                       dtype=np.uint8)
    return (np.array([known[f] for f in todo], dtype=np.uint8), compose.ravel(),
            np.array(functions, dtype=np.uint8))


_GENERATORS, _COMPOSE, _FUNCTIONS = _monoid()
_SIZE = len(_FUNCTIONS)
_STARTS = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)], dtype=bool).ravel()
_CLASSES: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, other, or white space."""
    if not _CLASSES:
        names = "".join(map(unicodedata.category, map(chr, range(0x110000)))).encode()
        major = np.frombuffer(names, dtype=np.uint8)[::2]
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        table[major == ord("L")], table[major == ord("N")] = LETTER, NUMBER
        table[WHITE_SPACE] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``first`` marks the first one of each text."""
    symbols = code_point_classes()[points]
    same = np.empty(len(points), dtype=bool)      # the next code point is in the same text
    same[:-1] = ~first[1:]
    same[-1] = False
    space = symbols == SPACE
    at = np.flatnonzero(space & same)
    at = at[symbols[at + 1] != SPACE]
    symbols[at] = np.where(points[at] == 0x20, LEAD, LAST)
    at = np.flatnonzero((points == 0x27) & same)
    if len(at):
        after = points[at + 1]
        symbols[at[np.isin(after, [ord(c) for c in ONE_LETTER])]] = SHORT
        at = at[at + 2 < len(points)]
        at = at[same[at + 1]]
        pair = points[at + 1].astype(np.int64) << 32 | points[at + 2]
        symbols[at[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS])]] = LONG
    return symbols


def _states_before(items: np.ndarray) -> np.ndarray:
    """Token state before every item, by a blocked scan of transition functions."""
    n = len(items)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint8)
    grid[:n] = items
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    before = np.empty_like(grid)
    run = np.zeros(blocks, dtype=np.uint8)
    for j in range(BLOCK):
        before[j] = run
        run = _COMPOSE[run.astype(np.uint16) * _SIZE + grid[j]]
    if blocks > BLOCK:
        entry = _states_before(run)
    else:
        entry = np.empty(blocks, dtype=np.uint8)
        state = CLOSED
        for i, f in enumerate(run.tolist()):
            entry[i] = state
            state = _FUNCTIONS[f, state]
    states = _FUNCTIONS.ravel()[before.astype(np.uint16) * 8 + entry.astype(np.uint16)[None, :]]
    return np.ascontiguousarray(states.T).ravel()[:n]


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of code points that start a pre-token; no token crosses a text's start."""
    symbols = _symbols(points, first)
    items = _GENERATORS[symbols + np.uint8(8) * first]
    states = _states_before(items)
    return np.flatnonzero(_STARTS[states.astype(np.uint8) * 8 + symbols] | first)


class Encoder:
    """Pair merging with a vocabulary of ranks, cached by slice."""

    def __init__(self, ranks: dict[bytes, int], specials: dict[str, int] | None = None):
        self.ranks = ranks
        self.specials = {k.encode(): v for k, v in (specials or {}).items()}
        self.vocabulary = {v: k for k, v in ranks.items()} | {v: k for k, v in self.specials.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys = []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20 | b, rank))
        keys.sort()
        self.pairs = dict(keys)
        self._fill_slots(np.array([k for k, _ in keys], dtype=np.int64), np.array([r for _, r in keys], dtype=np.int32))
        byte = self.single.astype(np.int64)
        self.byte_pairs = self._rank(np.repeat(byte, 256), np.tile(byte, 256))
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def from_file(cls, path: str, specials: dict[str, int] | None = None) -> Encoder:
        """Read a rank file: base64 of a token's bytes and its rank on each line."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, specials)

    def _fill_slots(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs, a quarter full or less."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_keys = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_ranks = np.full(1 << bits, NO_RANK, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_keys[at[todo]] < 0]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.slot_keys[at[free]], self.slot_ranks[at[free]] = keys[free], ranks[free]
            todo = todo[self.slot_keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to; an id below 0 is part of no pair."""
        key = left.astype(np.int64) << 20 | right
        at = self._slot(key)
        seen = self.slot_keys[at]
        out = self.slot_ranks[at]
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.last
            seen = self.slot_keys[at[todo]]
            out[todo] = self.slot_ranks[at[todo]]
            todo = todo[(seen != key[todo]) & (seen >= 0)]
        out[key < 0] = NO_RANK
        return out

    def merge_together(self, slices: list[bytes]) -> list[bytes]:
        """Ids of many short slices, as packed unsigned 32-bit integers: in every round each
        slice merges its first pair of lowest rank, until no slice has a pair left."""
        sizes = np.array([len(s) for s in slices])
        width = int(sizes.max()) + 1
        raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in slices), dtype=np.uint8).reshape(len(slices), width)
        ids = self.single[raw]
        columns = np.arange(width, dtype=np.int32)
        ids[columns[None, :] >= sizes[:, None]] = -1
        ranks = np.full_like(ids, NO_RANK)
        ranks[:, :-1] = self.byte_pairs[raw[:, :-1].astype(np.uint16) << 8 | raw[:, 1:]]
        ranks[columns[None, :] + 1 >= sizes[:, None]] = NO_RANK
        done = np.array(ids)
        live = np.arange(len(slices))
        while True:
            best = ranks.argmin(axis=1)
            rows = np.arange(len(best))
            value = ranks[rows, best]
            go = value < NO_RANK
            if not go.all():
                done[live[~go]] = ids[~go]
                live, ids, ranks, best, value = live[go], ids[go], ranks[go], best[go], value[go]
                if not len(live):
                    break
                rows = np.arange(len(best))
            after = columns[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ids[rows, best] = value
            # The last column of a slice is always free.
            ranks[rows, best] = self._rank(value, ids[rows, best + 1])
            left = best > 0
            where, at = rows[left], best[left] - 1
            ranks[where, at] = self._rank(ids[where, at], value[left])
        counts = (done >= 0).sum(axis=1).tolist()
        packed = done.astype("<u4")
        return [packed[i, :n].tobytes() for i, n in enumerate(counts)]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long slice: a heap of pairs over a linked list of symbols."""
        import heapq
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := self.pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := self.pairs.get(rank << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := self.pairs.get(ids[h] << 20 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode_slices(self, slices: list[bytes]) -> list[bytes]:
        """Packed ids of every slice, from the cache or by merging."""
        cache = self.cache
        found = list(map(cache.get, slices))
        if None not in found:
            return found
        missing = {s for s, ids in zip(slices, found) if ids is None}
        if len(cache) + len(missing) > CACHE_SLICES:
            cache.clear()
        fresh: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for s in missing:
            if s in self.ranks:
                fresh[s] = self.ranks[s].to_bytes(4, "little")
            elif len(s) > WIDE:
                fresh[s] = self.merge_long(s)
            else:
                by_width.setdefault(len(s) + 3 & ~3, []).append(s)
        for group in by_width.values():
            for k in range(0, len(group), 20_000):
                part = group[k:k + 20_000]
                fresh.update(zip(part, self.merge_together(part)))
        cache.update((s, ids) for s, ids in fresh.items() if len(s) <= WIDE)
        return [fresh[s] if ids is None else ids for s, ids in zip(slices, found)]

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of every UTF-8 text."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[tuple[int, bytes]] = []
        room = PART_BYTES
        for k, text in enumerate(texts):
            for piece in self._pieces(text):
                if isinstance(piece, int):
                    self._flush(parts, out)
                    parts, room = [], PART_BYTES
                    out[k].append(piece.to_bytes(4, "little"))
                    continue
                for part in _parts(piece):
                    if len(part) > room and parts:
                        self._flush(parts, out)
                        parts, room = [], PART_BYTES
                    parts.append((k, part))
                    room -= len(part)
        self._flush(parts, out)
        return [b"".join(x) for x in out]

    def _pieces(self, text: bytes) -> list[bytes | int]:
        """The text cut at special tokens (whose ids stand between the cuts), if there are any."""
        pieces: list[bytes | int] = [text]
        for special, rank in self.specials.items():
            if special in text:
                cut: list[bytes | int] = []
                for piece in pieces:
                    if isinstance(piece, int):
                        cut.append(piece)
                        continue
                    for i, x in enumerate(piece.split(special)):
                        cut += [rank, x] if i else [x]
                pieces = cut
        return [x for x in pieces if x != b""]

    def _flush(self, parts: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        if not parts:
            return
        buffer = b"".join(p for _, p in parts)
        raw = np.frombuffer(buffer, dtype=np.uint8)
        points = np.frombuffer(buffer.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(p) for _, p in parts])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        if len(points) == len(raw):
            offsets = None
            text_starts = begin
        else:
            offsets = np.flatnonzero((raw & 0xC0) != 0x80)
            text_starts = np.searchsorted(offsets, begin)
        first = np.zeros(len(points), dtype=bool)
        first[text_starts] = True
        starts = token_starts(points, first)
        own = np.searchsorted(starts, text_starts).tolist() + [len(starts)]
        if offsets is not None:
            starts = offsets[starts]
        slices, which = _distinct_slices(buffer, starts, np.append(starts[1:], len(buffer)))
        found = self.encode_slices(slices)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        firsts = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[
            np.repeat(firsts[which] - ends[:-1], counts[which]) + np.arange(ends[-1])]
        for i, (k, _) in enumerate(parts):
            out[k].append(ids[ends[own[i]]:ends[own[i + 1]]].tobytes())

    def tables(self) -> tuple[list[bytes], np.ndarray]:
        """Bytes of every id (None where an id is free) and their lengths, for decoding."""
        top = max(self.vocabulary) + 1
        words = [self.vocabulary.get(i) for i in range(top)]
        return words, np.array([len(w or b"") for w in words], dtype=np.int64)


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _distinct_slices(buffer: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Slices of the buffer, and which of them each pair of ``begin`` and ``end`` cuts out.

    Slices of up to eight bytes are told apart as numbers and named once; longer
    ones, and all of a buffer with zero bytes, stand each for itself.
    """
    sizes = end - begin
    short = np.flatnonzero(sizes <= 8) if b"\0" not in buffer else np.zeros(0, dtype=np.int64)
    eight = np.ndarray(len(buffer), dtype="<u8", buffer=buffer + bytes(8), strides=(1,))
    numbers, place = np.unique(eight[begin[short]] & _FIRST_BYTES[sizes[short]], return_inverse=True)
    which = np.empty(len(begin), dtype=np.int64)
    which[short] = place
    long = np.ones(len(begin), dtype=bool)
    long[short] = False
    long = np.flatnonzero(long)
    which[long] = len(numbers) + np.arange(len(long))
    slices = numbers.astype("<u8").view("S8").tolist()
    return slices + [buffer[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist())], which


def _parts(text: bytes) -> Iterator[bytes]:
    """A very long text, cut before spaces that surely start a pre-token."""
    while len(text) > 2 * PART_BYTES:
        at = PART_BYTES
        while True:
            at = text.find(b" ", at)
            if at < 0 or at + 1 >= len(text):
                yield text
                return
            if 0x21 <= text[at + 1] <= 0x7E:
                break
            at += 1
        yield text[:at]
        text = text[at:]
    if text:
        yield text


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, specials: dict[str, int] | None = None) -> Encoder:
    """The worker's own encoder of a rank file, read once."""
    key = (path, tuple(sorted((specials or {}).items())))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder.from_file(path, specials)
    return _ENCODERS[key]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred rows, so that what a worker holds at once stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


def _bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "token_ids",
           offsets: str | None = None, decoded: str | None = None,
           specials: dict[str, int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add a text's token ids as a packed binary column (little-endian unsigned 32-bit).

    ``offsets`` adds the byte offset of every token in the text, packed alike as
    unsigned 64-bit integers; ``decoded`` adds the bytes that the ids decode to.
    ``keep`` names the columns that stay (all by default); an added column
    replaces one of the same name.  A null or empty text gives no ids (an empty
    binary).  ``specials`` maps strings to ids that they get wherever they stand
    in a text; by default every text is ordinary text.  Rows are independent:
    repeated rows and ties need no care, an empty table gives an empty table.
    """
    added = [ids, *filter(None, (offsets, decoded))]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.BinaryType()) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, specials)
        words, lengths = own.tables()
        for batch in _portions(batches):
            packed = own.encode_texts(_bytes_of(batch.column(batch.schema.get_field_index(_TEXT))))
            new = [pa.array(packed, type=pa.binary())]
            if offsets:
                new.append(pa.array([token_offsets(x, lengths) for x in packed], type=pa.binary()))
            if decoded:
                new.append(pa.array([decode_ids(x, words) for x in packed], type=pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + new, names=keep + added)

    source = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias(_TEXT))
    return source.mapInArrow(run, schema)


_TEXT = "__text_to_encode"


def token_offsets(packed: bytes, lengths: np.ndarray) -> bytes:
    """Byte offsets at which the tokens start, packed as unsigned 64-bit integers."""
    sizes = lengths[np.frombuffer(packed, dtype="<u4")]
    return (np.cumsum(sizes) - sizes).astype("<u8").tobytes()


def decode_ids(packed: bytes, words: list[bytes]) -> bytes:
    """Bytes that packed ids stand for."""
    return b"".join(map(words.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded",
           specials: dict[str, int] | None = None) -> DataFrame:
    """Add the bytes that packed ids decode to; null ids decode to an empty binary."""
    keep = [c for c in encoded.columns if c != out]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = encoder(ranks_path, specials).tables()
        at = keep.index(ids)
        for batch in _portions(batches):
            new = pa.array([decode_ids(x or b"", words) for x in batch.column(at).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [new],
                                             names=[*keep, out])

    return encoded.select(*[encoded[f"`{c}`"] for c in keep]).mapInArrow(run, schema)
