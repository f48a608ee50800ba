"""Problem 8: encoding the corpus with a public byte-level BPE vocabulary.

Pre-tokenisation runs over whole batches without regex. The texts of a batch become one array of
code points; a table maps each to a class (letter, number, white space, other). Most boundaries
follow from a character's neighbours:

* a run of letters, numbers or others is one piece, with a single space before it if there is one;
* white space before a visible character gives up its last character: a space joins the piece
  that follows, anything else stands alone.

Contractions (an apostrophe that opens a piece and is followed by s, t, m, d, re, ve or ll) depend on
where the piece before ended, which may itself be a contraction. They are located by an automaton of
four states. Every character is a transition function from state to state, coded as one byte (two
bits a state); composing functions is associative, so the state before every character comes from a
blocked prefix scan over the bytes with one table of compositions.

The slices feed a cached pair merging; piece ids index a flat table of token ids, so the ids of a
batch are one gather. ``encode_with_offsets`` keeps the offsets of the pieces beside the ids, and
``decode_slice`` uses them to get any stretch of a text back from its tokens.

Defined results: empty and null texts give an empty list; text that looks like a control token is
ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@lru_cache(1)
def class_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    cat = unicodedata.category
    for c in range(0x110000):
        k = cat(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[_WHITE] = SPACE
    return t


# States of the automaton before a character: a piece may go on, or a contraction has one or two more
# characters, or a contraction has just ended. A transition function is a byte, two bits a state.
GOES_ON, ONE_MORE, TWO_MORE, ENDED = range(4)
_WIDTH = 128


def _function(to: tuple[int, int, int, int]) -> int:
    return sum(v << 2 * k for k, v in enumerate(to))


_PLAIN = _function((GOES_ON, ENDED, ONE_MORE, GOES_ON))


@lru_cache(1)
def _composed() -> np.ndarray:
    """then[f, g]: the function that applies f, then g."""
    f, g = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    out = np.zeros((256, 256), np.int64)
    for k in range(4):
        out |= (g >> 2 * (f >> 2 * k & 3) & 3) << 2 * k
    return out.astype(np.uint8).ravel()


def scan_states(f: np.ndarray) -> np.ndarray:
    """State before every character, from GOES_ON: an exclusive prefix scan of transition functions.
    Blocks are scanned side by side, then the blocks' own functions, then both are put together."""
    then, n = _composed(), len(f)
    rows = -(-n // _WIDTH)
    cells = np.full(rows * _WIDTH, _function((0, 1, 2, 3)), np.uint8)
    cells[:n] = f
    cells = cells.reshape(rows, _WIDTH)
    before = np.empty((rows, _WIDTH), np.uint8)
    acc = np.full(rows, _function((0, 1, 2, 3)), np.uint8)
    for j in range(_WIDTH):
        before[:, j] = acc
        acc = then[acc.astype(np.int32) << 8 | cells[:, j]]
    if rows > _WIDTH:
        enter = scan_states(acc)
    else:
        enter, state = np.zeros(rows, np.uint8), GOES_ON
        for r in range(rows):
            enter[r] = state
            state = int(acc[r]) >> 2 * state & 3
    return (before >> 2 * enter[:, None] & 3).ravel()[:n]


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start positions of the pieces of all texts. cp: code points of the texts one after another;
    first: start positions of the texts that aren't empty."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    k = class_table()[cp]
    edge = np.zeros(n + 1, bool)  # the first character of a text
    edge[first] = True
    edge[n] = True
    run = edge[:n].copy()
    run[1:] |= k[1:] != k[:-1]
    start = run.copy()
    white = k == SPACE
    # last white character before a visible one of the same text
    gives = np.zeros(n, bool)
    gives[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    start |= gives  # it leaves its run
    joins = gives & (cp == 32)
    start[np.flatnonzero(joins) + 1] = False  # the piece begins with the space
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        ahead = np.zeros((2, len(quote)), np.int64)
        for j in (1, 2):
            at = quote + j
            ok = at < n
            ok[ok] &= ~edge[at[ok]]
            if j == 2:
                ok &= ahead[0] > 0
            ahead[j - 1][ok] = cp[at[ok]]
        size = np.where(np.isin(ahead[0], [ord(c) for c in "stmd"]), ONE_MORE, GOES_ON)
        for a, b in ("re", "ve", "ll"):
            size[(ahead[0] == ord(a)) & (ahead[1] == ord(b))] = TWO_MORE
        if size.any():
            f = np.full(n, _PLAIN, np.uint8)
            f[quote] = [_function((s if go else GOES_ON, ENDED, ONE_MORE, s)) for s, go in zip(size.tolist(), start[quote].tolist())]
            fresh = edge[:n]
            f[fresh] = [(x & 3) * 0b01010101 for x in f[fresh].tolist()]  # a text begins anew
            state = scan_states(f)
            state[fresh] = GOES_ON
            start |= state == ENDED
            start[(state == ONE_MORE) | (state == TWO_MORE)] = False
    return np.flatnonzero(start)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 20


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i for every position of a block, and one more."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for x in (_BASE, inverse):
        a = np.full(_BLOCK + 1, x, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def slice_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice: differences of prefix sums, moved back to position 0. Slices
    longer than a block are hashed one by one."""
    mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers()
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        if int(ends[hi - 1]) - base > _BLOCK:
            import xxhash

            out[lo] = np.uint64(xxhash.xxh3_64_intdigest(cp[base : int(ends[lo])].tobytes()))
            lo += 1
            continue
        part = mixed[base : int(ends[hi - 1])]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=prefix[1:])
        s = starts[lo:hi] - base
        out[lo:hi] = (prefix[ends[lo:hi] - base] - prefix[s]) * down[s]
        lo = hi
    return out


class Merger:
    """Slices -> rows of a flat table of token ids. A slice is found by hash in a direct-mapped
    table (a sorted one takes what doesn't fit there) and then compared character by character
    with the slice that made the row, so equal hashes of different slices do no harm. Merges are
    made once per distinct slice."""

    #: Distinct slices kept by a worker; beyond it the cache starts anew, results are the same.
    KEEP = 1_500_000
    BITS = 20

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.reset()

    def reset(self) -> None:
        self.slot_hash = np.zeros(1 << self.BITS, np.uint64)
        self.slot_row = np.full(1 << self.BITS, -1, np.int32)
        self.more_hash, self.more_row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.chars = np.zeros(0, np.uint32)  # of the rows' slices, one after another
        self.char_base, self.char_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)  # token ids of the rows, one after another
        self.base, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        if len(self.size) > self.KEEP:
            self.reset()

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        row = np.where(self.slot_hash[slot] == h, self.slot_row[slot], -1)
        if len(self.more_hash):
            rest = np.flatnonzero(row < 0)
            if len(rest):
                at = np.minimum(np.searchsorted(self.more_hash, h[rest]), len(self.more_hash) - 1)
                row[rest] = np.where(self.more_hash[at] == h[rest], self.more_row[at], -1)
        return row

    def add(self, h: np.ndarray, slices: list[np.ndarray]) -> None:
        rows = np.arange(len(self.size), len(self.size) + len(h), dtype=np.int32)
        ids = [self.merge(c.tobytes().decode("utf-32-le").encode("utf-8")) for c in slices]
        size = np.array([len(i) for i in ids], np.int64)
        self.base = np.concatenate([self.base, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.array([x for i in ids for x in i], np.int32)])
        size = np.array([len(c) for c in slices], np.int64)
        self.char_base = np.concatenate([self.char_base, len(self.chars) + np.cumsum(size) - size])
        self.char_size = np.concatenate([self.char_size, size])
        self.chars = np.concatenate([self.chars, *slices])
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        free = self.slot_row[slot] < 0
        first = np.zeros(len(h), bool)
        first[np.unique(slot, return_index=True)[1]] = True
        free &= first
        self.slot_hash[slot[free]], self.slot_row[slot[free]] = h[free], rows[free]
        more = np.concatenate([self.more_hash, h[~free]])
        order = np.argsort(more, kind="stable")
        self.more_hash, self.more_row = more[order], np.concatenate([self.more_row, rows[~free]])[order]

    def rows(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
        """The row of every slice; and the ids of slices whose hash belongs to another slice."""
        h = slice_hashes(cp, starts, ends)
        row = self.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            distinct, at = np.unique(h[new], return_index=True)
            at = new[at]
            self.add(distinct, [cp[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            row[new] = self.find(h[new])
        size = ends - starts
        wrong = self.char_size[row] != size
        shift = np.repeat(self.char_base[row] - starts, np.where(wrong, 0, size))
        keep = np.repeat(~wrong, size)
        at = np.arange(int(starts[0]) if len(starts) else 0, int(ends[-1]) if len(ends) else 0)
        at = at[keep] if wrong.any() else at
        differs = np.flatnonzero(self.chars[at + shift] != cp[at])
        if len(differs):
            wrong[np.searchsorted(starts, at[differs], "right") - 1] = True
        own = {int(i): self.merge(cp[starts[i] : ends[i]].tobytes().decode("utf-32-le").encode("utf-8")) for i in np.flatnonzero(wrong)}
        return row, own

    def merge(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 400:
            return self.merge_long(parts)
        pair = [ranks.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:])]
        while pair:
            low = min(pair)
            if low == sys.maxsize:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], sys.maxsize)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], sys.maxsize)
        return [ranks[p] for p in parts]

    def merge_long(self, parts: list[bytes]) -> list[int]:
        """The same merges with a heap over a linked list: very long pieces stay near-linear."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live: list[bytes | None] = list(parts)
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            if live[i] is None or (j := after[i]) >= n or live[i] + live[j] != both:
                continue
            live[i], live[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(both + live[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, both + live[after[j]]))
            if (h := before[i]) >= 0 and (r := ranks.get(live[h] + both)) is not None:
                heapq.heappush(heap, (r, h, live[h] + both))
        return [ranks[p] for p in live if p is not None]


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(path)


def vocabulary(name: str) -> str:
    return os.path.join(TOKENIZER_DIR, f"{name}.tiktoken")


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, piece starts, piece ends, pieces before each text and in all)."""
    whole = "".join([t or "" for t in texts])
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    starts = piece_starts(cp, begin[size > 0])
    ends = np.append(starts[1:], len(cp)) if len(starts) else starts
    return cp, starts, ends, np.searchsorted(starts, np.append(begin, len(cp)))


def encode_batch(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, list offsets, piece ends in characters); null counts as empty."""
    m = merger(path)
    m.trim()
    cp, starts, ends, before = cut(texts)
    row, own = m.rows(cp, starts, ends)
    each = m.size[row]
    base = m.base[row]
    flat = m.flat
    if own:
        for i, ids in own.items():
            each[i], base[i] = len(ids), len(flat)
            flat = np.concatenate([flat, np.array(ids, np.int32)])
    stop = np.cumsum(each)
    total = int(stop[-1]) if len(stop) else 0
    ids = flat[np.arange(total) + np.repeat(base - (stop - each), each)]
    return ids, np.concatenate([[0], stop])[before], ends


def count_batch(texts: list[str | None], path: str) -> np.ndarray:
    m = merger(path)
    m.trim()
    cp, starts, ends, before = cut(texts)
    row, own = m.rows(cp, starts, ends)
    each = m.size[row]
    for i, ids in own.items():
        each[i] = len(ids)
    total = np.concatenate([[0], np.cumsum(each)])[before]
    return total[1:] - total[:-1]


@lru_cache(4)
def _tokens(path: str) -> dict[int, bytes]:
    return {v: k for k, v in merger(path).ranks.items()}


def decode(ids, path: str) -> str:
    back = _tokens(path)
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def _split(b: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded text size, at least one row each."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > chars:
            yield b.slice(lo, i - lo)
            lo, total = i, 0
        total += int(s)
    yield b.slice(lo)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _split(whole, "text"):
                ids, stops, _ = encode_batch(b.column("text").to_pylist(), path)
                lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, name: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every document's whole text. One narrow pass, no shuffle."""
    path = os.path.join(directory or TOKENIZER_DIR, f"{name}.tiktoken")
    return documents.select("doc_id", "text").mapInArrow(_encoder(path), "doc_id bigint, ids array<int>")


def _encoder_with_offsets(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _split(whole, "text"):
                texts = b.column("text").to_pylist()
                m = merger(path)
                m.trim()
                cp, starts, ends, before = cut(texts)
                row, own = m.rows(cp, starts, ends)
                each = m.size[row]
                for i, ids in own.items():
                    each[i] = len(ids)
                begin = np.repeat(np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])[:-1], np.diff(before))
                total = np.cumsum(each) if len(each) else np.zeros(0, np.int64)
                base = np.repeat(np.concatenate([[0], total])[before][:-1], np.diff(before))
                ids, stops, _ = encode_batch(texts, path)
                lists = lambda v, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(ids, stops), lists(ends - begin, before), lists(total - base, before)], ["doc_id", "ids", "piece_ends", "piece_ids"])

    return run


def encode_with_offsets(documents: DataFrame, name: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """(doc_id, ids, piece_ends, piece_ids): beside the ids, where every piece ends in characters of
    the text and in ids."""
    path = os.path.join(directory or TOKENIZER_DIR, f"{name}.tiktoken")
    return documents.select("doc_id", "text").mapInArrow(_encoder_with_offsets(path), "doc_id bigint, ids array<int>, piece_ends array<int>, piece_ids array<int>")


def decode_slice(ids: list[int], piece_ends: list[int], piece_ids: list[int], begin: int, end: int, path: str) -> str:
    """Characters begin..end of a text from its tokens; only the pieces they touch are decoded."""
    if end <= begin or not piece_ends:
        return ""
    a = int(np.searchsorted(piece_ends, begin, "right"))
    b = min(int(np.searchsorted(piece_ends, end, "left")), len(piece_ends) - 1)
    char, first = (piece_ends[a - 1], piece_ids[a - 1]) if a else (0, 0)
    return decode(ids[first : piece_ids[b]], path)[begin - char : end - char]


def _sizer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _split(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count_batch(b.column("text").to_pylist(), path))], ["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """(doc_id, tokens) without building the ids."""
    path = os.path.join(directory or TOKENIZER_DIR, f"{name}.tiktoken")
    return documents.select("doc_id", "text").mapInArrow(_sizer(path), "doc_id bigint, tokens bigint")
