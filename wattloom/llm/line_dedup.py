"""Line dedup by an exact set-similarity join: rarity order, prefix, positional and length filters, then Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import discard, fresh_key, grouped_frames, integer_ids, mixed, releasing, sliced, stash, temporary, unused

_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_BYTE = mixed(np.arange(1000, 1256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0xD6E8FEB86659FD93
#: Bits of the number of counters that rank the tokens, at every table size: 2^23 ranks of two bytes reach every task.
COUNTERS = 23
#: Bits of the number of counters in a chunk.
CHUNK = 16
#: Tokens that a task may get: more partitions are made where there are more.
PART_TOKENS = 5_000_000
_HELD = 1_000_000
_BYTES = 2_000_000
_GONE, _CLASS, _TOKEN, _PAIR = 0, 1, 2, 3
#: Lines of one side of a block.
BLOCK = 1024
#: Pairs of lines, or hubs, that may go to all tasks (about 20 MB).
SENT = 100_000
#: Bits of the number of bits that tell which lines are candidates, at every table size: 2^27, 16 MB in every task.
ASKED = 27
#: Tokens from which a line has more bits in crowds, and how many times 64.
LONG, MORE = 65, 4
#: Tokens from which a line has counters beside its bits.
COUNTED = 96
#: Lines that may share a token and be compared where the token is dealt.
FEW = 2048
#: Candidates that a line may have among those lines; beyond that they are a crowd.
NEAR = 16


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(1 << bits, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@dataclass(frozen=True)
class Scan:
    """Words and lines of some texts: hash of each word and its line; of each line its text and number in it, and, where
    asked for, its hash."""

    word: np.ndarray
    line: np.ndarray
    line_hash: np.ndarray | None
    text: np.ndarray
    no: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.line, minlength=len(self.text))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each with a line feed at its end, their ends)."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))


def _of(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the range, by the places where ranges end, of each of the ascending places at."""
    return np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(at, ends), prepend=0))


def _line_ranges(buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, number in it) of each line of joined texts."""
    end = np.flatnonzero(buf == 10)
    start = np.append(0, end[:-1] + 1)[: len(end)]
    text = _of(last, start)
    return start, end, text, np.arange(len(end)) - np.searchsorted(start, np.append(0, last[:-1])[: len(last)])[text]


def scanned(texts: list[str] | tuple[np.ndarray, np.ndarray], lines: bool = False) -> Scan:
    """All words and lines at once, of texts or their joined bytes: sums of byte values times powers of a base, whose
    differences, scaled back to the same place and mixed, are the hashes of byte ranges. lines: with hashes of lines."""
    buf, last = _joined(texts) if isinstance(texts, list) else texts
    start, end, text, no = _line_ranges(buf, last)
    powers, inverse = _powers(max(16, int(len(buf)).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers[: len(buf)], out=sums[1:])

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    letter = ~_BLANK[buf]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        edge = np.append(0, edge)
    words, ends = edge[::2], edge[1::2]  # the last byte is blank
    return Scan(hashed(words, ends), _of(end, words), hashed(start, end) if lines else None, text, no)


def tokens(s: Scan, words: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, its line), in text order, of the lines to keep. A token is a run of words in lower case; a
    line of fewer words is one token, a line of none has none."""
    if words == 1:
        at = slice(None) if keep is None else keep[s.line]
        return mixed(s.word[at] * _ODD[0]), s.line[at]
    n = s.n_words
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    if keep is not None:
        count = np.where(keep, count, 0)
    line = np.repeat(np.arange(len(n)), count)
    at = (np.cumsum(n) - n)[line] + np.arange(len(line)) - (np.cumsum(count) - count)[line]
    t = np.zeros(len(line), np.uint64)
    h = np.concatenate([s.word, np.zeros(words, np.uint64)])
    short = np.flatnonzero((n < words)[line])
    for i in range(words):
        x = h[at + i] * _ODD[i]
        gone = short[i >= n[line[short]]]
        x[gone] = _ODD[32 + i]
        t += x
    return mixed(t), line


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(row numbers, joined bytes of the texts) of a batch, in pieces of bounded size: the bytes are those of the batch,
    without Python objects in between."""
    col = b.column("text")
    col = col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    if not len(col):
        return
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _BYTES)))
        hi = min(hi, len(col))
        ends = at[lo + 1 : hi + 1] - at[lo]
        yield np.arange(lo, hi), (np.insert(data[at[lo] : at[hi]], ends, 10), ends + np.arange(1, hi - lo + 1))
        lo = hi


def _sparse(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counters that aren't 0, by chunk: their places in it and, in the least type that holds them, the counts."""
    for c in range(len(sums) >> CHUNK):
        own = sums[c << CHUNK : (c + 1) << CHUNK]
        at = np.flatnonzero(own)
        if len(at):
            kind = np.min_scalar_type(own.max())
            yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "width": pa.array([kind.itemsize], pa.int32()), "body": pa.array([at.astype(np.uint16).tobytes() + own[at].astype(kind).tobytes()], pa.binary())})


def _counts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Counters of the tokens of a task's lines; lines that repeat within a piece count once."""
    sums = np.zeros(1 << COUNTERS, np.uint64)
    for b in batches:
        for _, texts in _pieces(b):
            s = scanned(texts, lines=True)
            new = np.zeros(len(s.text), bool)
            new[np.unique(s.line_hash, return_index=True)[1]] = True
            np.add.at(sums, _counter(tokens(s, words, new)[0]), np.uint64(1))
    yield from _sparse(sums)


def _counter(t: np.ndarray) -> np.ndarray:
    return (t >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Sums of the counters of each chunk that a task gets; a chunk has a fixed size, however many rows it has."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, width, body in zip(*(b.column(x).to_pylist() for x in ("chunk", "width", "body")), strict=True):
            n = len(body) // (2 + width)
            own = sums.setdefault(c, np.zeros(1 << CHUNK, np.uint64))
            own[np.frombuffer(body, np.uint16, n)] += np.frombuffer(body, f"u{width}", n, 2 * n)
    return sums


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c, own in _added(batches).items():
        for b in _sparse(own):
            yield b.set_column(0, "chunk", pa.array([c], pa.int32()))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rank of each counter of a chunk (1024 for each doubling of the count) and the sum of the counts."""
    for c, own in _added(batches).items():
        rank = np.floor(1024 * np.log2(np.maximum(own, 1).astype(np.float64))).astype(np.uint16)
        yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "of": pa.array([int(own.sum())], pa.int64()), "body": pa.array([rank.tobytes()], pa.binary())})


def token_ranks(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """(rank of each counter, tokens counted): how frequent tokens are, over all of docs. A token's counter is chosen by
    its hash; the array has a fixed size, so tokens of one counter have the rank of their sum."""
    kind = "chunk int, width int, body binary"
    counted = docs.select("text").mapInArrow(releasing(lambda b: _counts(b, words)), kind)
    # first sums within 64 groups of tasks, so that no task gets a chunk's counters of all others
    parts = counted.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("chunk", "group").drop("group").mapInArrow(_summed, kind)
    ranks, total = np.zeros(1 << COUNTERS, np.uint16), 0
    for r in parts.repartition("chunk").mapInArrow(_ranked, "chunk int, of long, body binary").collect():
        ranks[r.chunk << CHUNK : (r.chunk + 1) << CHUNK] = np.frombuffer(r.body, np.uint16)
        total += r.of
    return ranks, total


def _ordered(t: np.ndarray, rank: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by line, then rank, then token: by one packed key unless that has ties."""
    if len(line) and line[-1] < 1 << 21:
        key = line.astype(np.uint64) << np.uint64(43) | rank.astype(np.uint64) << np.uint64(27) | t >> np.uint64(37)
        order = np.argsort(key)
        k, x = key[order], t[order]
        if not ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
            return order
    return np.lexsort((t, rank, line))


@dataclass
class Classes:
    """Lines with equal token sets: digest of the set, first line, bits of the set, its size, and its rarest tokens (a
    prefix; p tokens from place at on, as those before it are of no other line). A token turns one of 64 bits over, so
    sets differ in at least as many tokens as their bits do. In long lines, where many bits differ by chance, a token also
    adds to one of 16 counters modulo 16 (short ones have 0)."""

    h0: np.ndarray
    h1: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    bits: np.ndarray
    sums: np.ndarray
    n: np.ndarray
    at: np.ndarray
    p: np.ndarray
    token: np.ndarray

    @classmethod
    def joined(cls, parts: list[Classes]) -> Classes:
        return cls(*(np.concatenate([getattr(x, f.name) for x in parts]) for f in fields(cls)))

    def taken(self, at: np.ndarray) -> Classes:
        start, p = (np.cumsum(self.p) - self.p)[at], self.p[at]
        token = self.token[np.repeat(start - (np.cumsum(p) - p), p) + np.arange(p.sum())]
        return Classes(self.h0[at], self.h1[at], self.doc[at], self.line[at], self.bits[at], self.sums[at], self.n[at], self.at[at], p, token)

    def split(self) -> tuple[Classes, np.ndarray, np.ndarray]:
        """(the first line of each class, doc and line of the others)."""
        order = np.lexsort((self.line, self.doc, self.h1, self.h0))
        h0, h1, doc, line = self.h0[order], self.h1[order], self.doc[order], self.line[order]
        first = np.ones(len(order), bool)
        first[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        gone = (doc != doc[at]) | (line != line[at])
        return self.taken(order[first]), doc[gone], line[gone]


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: those of small numbers are 0 and compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(b: bytes, kind: type, rows: int) -> np.ndarray:
    """Columns of numbers that _planes packed one after the other."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(rows, size, -1).transpose(0, 2, 1)).view(kind)[:, :, 0]


def _row(kind: int, part: int, longs: list[np.ndarray], ints: list[np.ndarray], more: np.ndarray | None = None) -> tuple:
    join = lambda x, t: b"".join(_planes(np.ascontiguousarray(c, t)) for c in x)
    return part, kind, join(longs, np.int64), join(ints, np.int32), b"" if more is None else more.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["part", "kind", "longs", "ints", "more"])


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    """A number below parts from the top bits of a hash."""
    return ((h.astype(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i] : cuts[i + 1]]


#: Columns of longs and ints in a row of each kind.
_COLUMNS = {_GONE: (1, 1), _CLASS: (5, 4), _TOKEN: (3, 4)}
#: Columns of what _shared finds; those that a kind doesn't have are 0.
_FOUND = {"kind": "i4", "token": "i8", "doc": "i8", "line": "i4", "n": "i4", "at": "i4", "bits": "i8", "doc_b": "i8", "line_b": "i4", "differ": "i4"}


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for part, kind, longs, ints, more in zip(*(b.column(x).to_pylist() for x in ("part", "kind", "longs", "ints", "more")), strict=True):
            n, m = _COLUMNS[kind]
            yield part, kind, _numbers(longs, np.int64, n), _numbers(ints, np.int32, m), np.frombuffer(more, np.uint64)


def _sums(t: np.ndarray, size: np.ndarray) -> np.ndarray:
    """16 counters of four bits of each line of at least COUNTED tokens, else 0; t are the tokens of all lines."""
    long = size >= COUNTED
    line = np.repeat(np.cumsum(long) - 1, size)
    t, line = (x[np.repeat(long, size)] for x in (t, line))
    at = (mixed(t) >> np.uint64(48)).astype(np.int64) & 15
    n = np.bincount(16 * line + at, minlength=16 * int(long.sum())).astype(np.uint64).reshape(-1, 16) & np.uint64(15)
    out = np.zeros(len(size), np.uint64)
    out[long] = (n << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, least: int, threshold: float, ranks: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The lines with at least least words as classes, dealt by their digests; of lines of one class in a few pieces,
    all but the first are gone already."""
    held: list[Classes] = []

    def dealt() -> pa.RecordBatch:
        own, doc, line = Classes.joined(held).split()
        rows = [_row(_GONE, int(i), [doc[x]], [line[x]]) for i, x in _by_part(_bucket(mixed(doc.astype(np.uint64)), parts), parts)]
        for i, at in _by_part(_bucket(own.h0, parts), parts):
            c = own.taken(at)
            rows.append(_row(_CLASS, i, [c.h0, c.h1, c.doc, c.bits, c.sums], [c.line, c.n, c.at, c.p], c.token))
        return _batch(rows)

    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for rows, texts in _pieces(b):
            s = scanned(texts)
            t, line = tokens(s, words, s.n_words >= max(1, least))
            rank = ranks[_counter(t)]
            order = _ordered(t, rank, line)
            t, line, rank = t[order], line[order], rank[order]
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (line[1:] != line[:-1])
            t, line, rank = t[first], line[first], rank[first]
            n = np.bincount(line, minlength=len(s.text))
            some = np.flatnonzero(n)
            start = (np.cumsum(n) - n)[some]
            size = n[some]
            p = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[i : i + k]) for i, k in zip(start, size, strict=True)), np.int64).reshape(-1, 2)
            bits = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(t) >> np.uint64(58)), start).view(np.int64) if len(start) else np.empty(0, np.int64)
            take = np.repeat(start - (np.cumsum(p) - p), p) + np.arange(p.sum())
            single = rank[take] == 0  # counted once, so no other class has them
            at = np.bincount(np.repeat(np.arange(len(p)), p)[single], minlength=len(p))
            held.append(Classes(digests[:, 0], digests[:, 1], ids[rows[s.text[some]]].astype(np.int64), s.no[some], bits, _sums(t, size), size, at, p - at, t[take[~single]]))
            if sum(len(c.token) for c in held) > _HELD:
                yield dealt()
                held.clear()
    if held:
        yield dealt()


def _classes(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Classes dealt by digest: their first lines' prefixes, dealt by token; the other lines are gone. Held are only the
    first lines and a bounded number of new ones."""
    held: list[Classes] = []

    def firsts() -> pa.RecordBatch:
        own, doc, line = Classes.joined(held).split()
        held[:] = [own]
        return _batch([_row(_GONE, int(i), [doc[x]], [line[x]]) for i, x in _by_part(_bucket(mixed(doc.astype(np.uint64)), parts), parts)])

    new = 0
    for part, kind, a, b, token in _unpacked(batches):
        if kind == _GONE:
            yield _batch([_row(_GONE, part, [*a], [*b])])
            continue
        held.append(Classes(*a[:3], b[0], *a[3:], *b[1:], token))
        new += a.shape[1]
        if new > _HELD:
            yield firsts()
            new = 0
    if not held:
        return
    yield firsts()
    (own,) = held
    ends = np.cumsum(own.p.astype(np.int64))
    for lo in range(0, int(ends[-1]), _HELD):  # classes without tokens take no part
        at = np.arange(*np.searchsorted(ends, [lo, lo + _HELD], side="right"))
        if len(at):
            c = own.taken(at)
            of = np.repeat(np.arange(len(at)), c.p)
            place = np.arange(len(of)) - np.repeat(np.cumsum(c.p) - c.p, c.p) + c.at[of]
            short = c.token.astype(np.uint32).view(np.int32)  # within its part the half tells tokens apart
            yield _batch([_row(_TOKEN, i, [c.doc[of[x]], c.bits[of[x]], c.sums[of[x]]], [short[x], c.line[of[x]], c.n[of[x]], place[x]]) for i, x in _by_part(_bucket(c.token, parts), parts)])


@dataclass
class Prefixes:
    """Rows of prefix tokens: the half of the token that tells it apart within its part, line, size, place, bits and
    counters."""

    token: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    n: np.ndarray
    at: np.ndarray
    bits: np.ndarray
    sums: np.ndarray

    @classmethod
    def joined(cls, parts: list[Prefixes]) -> Prefixes:
        return cls(*(np.concatenate([getattr(x, f.name) for x in parts]) for f in fields(cls)))

    def taken(self, at: np.ndarray) -> Prefixes:
        return Prefixes(*(getattr(self, f.name)[at] for f in fields(self)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much counters differ at least: sets differ in at least as many tokens."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, 64, 4):
        d = (a >> np.uint64(i)) - (b >> np.uint64(i)) & np.uint64(15)
        out += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return out


def _candidates(x: Prefixes, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of (token, n): pairs of rows (later line, earlier line, bits that differ) of one token that
    sizes, places and bits allow, and whether each row is of a crowd: a token at which a line has more than NEAR."""
    start = x.token.astype(np.uint64) << np.uint64(32)
    low = np.searchsorted(start | x.n.astype(np.uint64), start | np.ceil(threshold * x.n - 1e-9).astype(np.uint64))
    many = np.arange(len(low)) - low
    ends, lo, found, crowded = np.cumsum(many), 0, [], [np.empty(0, np.uint32)]
    while lo < len(low):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _HELD, side="right")))
        m = many[lo:hi]
        a = np.repeat(np.arange(lo, hi), m)
        b = low[a] + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        both = x.n[a] + x.n[b]
        need = np.ceil(threshold / (1 + threshold) * both - 1e-9)
        differ = np.bitwise_count(x.bits[a] ^ x.bits[b])
        ok = (np.minimum(x.n[a] - x.at[a], x.n[b] - x.at[b]) >= need) & (differ <= both - 2 * need)
        a, b, differ, most = a[ok], b[ok], differ[ok], (both - 2 * need)[ok]
        long = np.flatnonzero(np.minimum(x.n[a], x.n[b]) >= COUNTED)
        ok = np.ones(len(a), bool)
        ok[long] = _apart(x.sums[a[long]], x.sums[b[long]]) <= most[long]
        a, b, differ = a[ok], b[ok], differ[ok]
        crowded.append(np.unique(x.token[lo:hi][np.bincount(a - lo, minlength=hi - lo) > NEAR]))
        ok = ~np.isin(x.token[a], crowded[-1])
        found.append((a[ok], b[ok], differ[ok]))
        lo = hi
    crowd = np.isin(x.token, np.concatenate(crowded))
    a, b, differ = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
    swap = (x.doc[a] < x.doc[b]) | (x.doc[a] == x.doc[b]) & (x.line[a] < x.line[b])
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    ok = ~crowd[a] & ((x.doc[a] != x.doc[b]) | (x.line[a] != x.line[b]))
    return a[ok], b[ok], differ[ok], crowd


def _shared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of prefix tokens dealt by token: the pairs of lines that share one and may match, the rows of tokens that crowds
    share, and the lines that are gone. Rows of a token leave once there are more than FEW, so those held are as many as
    a part has, however many rows a token has."""
    held: list[Prefixes] = []
    hot, new, of = np.empty(0, np.uint32), 0, 0

    def out(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
        size = len(columns["doc"])
        return pa.record_batch({k: columns.get(k, np.full(size, kind if k == "kind" else 0)).astype(t) for k, t in _FOUND.items()})

    def crowd(x: Prefixes) -> pa.RecordBatch:
        return out(_TOKEN, token=np.int64(of) << 32 | x.token.astype(np.int64), doc=x.doc, line=x.line, n=x.n, at=x.at, bits=x.bits.view(np.int64))

    def sifted() -> tuple[Prefixes, Prefixes]:
        """(rows of tokens that more than FEW lines have, rows of the others), in the order of (token, n)."""
        x = Prefixes.joined(held)
        x = x.taken(np.argsort(x.token.astype(np.uint64) << np.uint64(32) | x.n.astype(np.uint64)))
        first = np.flatnonzero(np.append(True, x.token[1:] != x.token[:-1]))
        size = np.diff(np.append(first, len(x.token)))
        size = np.repeat(size, size)
        return x.taken(size > FEW), x.taken(size <= FEW)

    for part, kind, a, b, _ in _unpacked(batches):
        if kind == _GONE:
            yield out(_GONE, doc=a[0], line=b[0])
            continue
        of = part
        x = Prefixes(b[0].view(np.uint32), a[0], *b[1:], *a[1:].view(np.uint64))
        known = np.isin(x.token, hot)
        if known.any():
            yield crowd(x.taken(known))
            x = x.taken(~known)
        held.append(x)
        new += len(x.token)
        if new > _HELD:
            many, rest = sifted()
            yield crowd(many)
            hot, held, new = np.union1d(hot, many.token), [rest], 0
    if held:
        many, rest = sifted()
        yield crowd(many)
        a, b, differ, crowded = _candidates(rest, threshold)
        yield crowd(rest.taken(crowded))
        for lo in range(0, len(a), _HELD):
            x, y = a[lo : lo + _HELD], b[lo : lo + _HELD]
            yield out(_PAIR, doc=rest.doc[x], line=rest.line[x], doc_b=rest.doc[y], line_b=rest.line[y], differ=differ[lo : lo + _HELD])


def _similar(pairs: pd.DataFrame, words: int, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of the lines t_a, t_b of each pair is at least threshold: the tokens of both are
    sorted together, by one packed key unless that has ties, and equal ones are neighbours."""
    t, row = tokens(scanned([x for both in zip(pairs["t_a"], pairs["t_b"], strict=True) for x in both]), words)
    pair, side = row >> 1, np.uint8(1) << (row & 1).astype(np.uint8)
    low = np.uint64(max(1, len(pairs).bit_length()))
    key = pair.astype(np.uint64) << (np.uint64(64) - low) | t >> low
    order = np.argsort(key)
    k, x = key[order], t[order]
    if ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
        order = np.lexsort((t, pair))
    t, pair = t[order], pair[order]
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (pair[1:] != pair[:-1]))[: len(t)])
    sides = np.bitwise_or.reduceat(side[order], first) if len(first) else side
    both, either = (np.bincount(pair[at], minlength=len(pairs)) for at in (first[sides == 3], first))
    return both >= threshold * either - 1e-9


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The bit that stands for a line."""
    return mixed(mixed(doc.astype(np.uint64)) + line.astype(np.uint64)) >> np.uint64(64 - ASKED)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of lines, by the words of 64 bits that they are in."""
    for b in batches:
        at = np.unique(_place(*(b.column(x).to_numpy(zero_copy_only=False) for x in ("doc", "line"))))
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.record_batch({"word": word.astype(np.int32), "mask": mask.view(np.int64)})


def asked_lines(lines: DataFrame) -> np.ndarray:
    """Bits of which those of lines (doc, line) are set; the array has a fixed size, so that others may share them."""
    rows = lines.mapInArrow(_masks, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(1 << (ASKED - 6), np.uint64)
    bits[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return bits


def _picked(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The lines of each text whose bits are set, among them all that are asked for."""
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for rows, (buf, last) in _pieces(b):
            start, end, text, no = _line_ranges(buf, last)
            doc = ids[rows[text]].astype(np.int64)
            at = _place(doc, no)
            some = np.flatnonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            raw = buf.tobytes()
            t = pa.array([raw[i:j] for i, j in zip(start[some].tolist(), end[some].tolist(), strict=True)], pa.string())
            yield pa.record_batch({"doc": pa.array(doc[some]), "line": pa.array(no[some].astype(np.int32)), "t": t})


def _allowed(a: str, b: str, threshold: float) -> Column:
    """Length and positional filters for a token at places at_a, at_b of the ordered sets of n_a, n_b tokens, and a filter
    of bits: similar sets differ in few tokens, so in few bits."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    need = F.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
    near = F.bit_count(F.col(f"bits_{a}").bitwiseXOR(F.col(f"bits_{b}"))) <= na + nb - 2 * need
    return (F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9) & (F.least(na - F.col(f"at_{a}"), nb - F.col(f"at_{b}")) >= need) & near


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc, line) of the first line of each pair whose Jaccard similarity is at least threshold."""
    side = lambda x: texts.select(F.col("doc").alias(f"doc_{x}"), F.col("line").alias(f"line_{x}"), F.col("t").alias(f"t_{x}"), fresh_key("doc", "line").alias("k"))
    both = pairs.withColumn("k", fresh_key("doc_a", "line_a")).join(side("a"), ["k", "doc_a", "line_a"]).drop("k")
    both = both.withColumn("k", fresh_key("doc_b", "line_b")).join(side("b"), ["k", "doc_b", "line_b"])

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sliced(frames, "t_a", "t_b"):
            yield f.loc[_similar(f, words, threshold), ["doc_a", "line_a"]].rename(columns={"doc_a": "doc", "line_a": "line"})

    return both.select("doc_a", "line_a", "t_a", "t_b").mapInPandas(releasing(matched), "doc long, line int").distinct()


def _more_bits(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """64 x MORE bits of each line, of which each token turns one over."""
    for f in sliced(frames, "t"):
        t, row = tokens(scanned(list(f["t"])), words)
        order = np.lexsort((t, row))
        t, row = t[order], row[order]
        new = np.append(True, (t[1:] != t[:-1]) | (row[1:] != row[:-1]))[: len(t)]
        place = mixed(t[new]) >> np.uint64(32)
        bits = np.zeros((len(f), MORE), np.uint64)
        np.bitwise_xor.at(bits, (row[new], (place >> np.uint64(6)) % np.uint64(MORE)), np.uint64(1) << (place & np.uint64(63)))
        yield pd.DataFrame({"doc_a": f["doc"], "line_a": f["line"], "more": pd.Series([x.tobytes() for x in bits], index=f.index, dtype=object)})


def _crowds(members: DataFrame, threshold: float) -> DataFrame:
    """Lines with the earliest line (the hub) of each token of members that they have, and whether they may match it."""
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("doc", "line", "n", "at", "bits")]
    hubs = members.groupBy("token").agg(F.min(F.struct("doc", "line", "n", "at", "bits")).alias("b"))
    hubs = stash(hubs.select("token", *(F.col(f"b.{c}").alias(f"{c}_b") for c in ("doc", "line", "n", "at", "bits"))), "hubs")
    sent = F.broadcast if hubs.count() <= SENT else (lambda t: t)
    met = members.select(*side("a"), "token", fresh_key("token").alias("k")).join(sent(hubs.withColumn("k", fresh_key("token"))), ["k", "token"]).where("doc_a <> doc_b or line_a <> line_b")
    return met.groupBy("doc_a", "line_a", "n_a", "bits_a", "doc_b", "line_b").agg(F.max(_allowed("a", "b", threshold)).alias("ok"))


def _pairs_in_crowds(crowd: DataFrame, threshold: float, every: bool) -> DataFrame:
    """doc_a, line_a, doc_b, line_b: lines of a crowd (those that share tokens with its hub) with earlier lines of it that
    they may match by sizes and bits; every: all of these, else the one in each block whose bits are nearest.

    Lines that aren't done meet all others in blocks of BLOCK by BLOCK. Only numbers are dealt, no texts; long lines, in
    which 64 bits are too few to tell sets apart, have more bits.
    """
    hub = ["doc_b", "line_b"]
    open_ = crowd.groupBy(*hub).agg(F.count("*").alias("m"), F.count_if(F.col("done").isNull()).alias("o")).where("o > 0 and m > 1")
    open_ = open_.select(*hub, F.ceil(F.col("o") / BLOCK).cast("int").alias("bi"), F.ceil(F.col("m") / BLOCK).cast("int").alias("bj"), fresh_key(*hub).alias("k"))
    sides = crowd.withColumn("k", fresh_key(*hub)).join(open_, ["k", *hub]).drop("k").withColumnsRenamed({f"{c}_a": c for c in ("doc", "line", "n", "bits")})
    at = lambda n: F.pmod(F.xxhash64(F.lit(29), "doc", "line"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = [*hub, "doc", "line", "n", "bits", "more"]
    one = sides.where("done is null").select(*row, F.lit(True).alias("first"), at("bi").alias("i"), upto("bj").alias("j"))
    other = sides.select(*row, F.lit(False).alias("first"), upto("bi").alias("i"), at("bj").alias("j"))
    tasks = one.unionByName(other).repartition(*hub, "i", "j").sortWithinPartitions(*hub, "i", "j")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, cuts in grouped_frames(frames, [*hub, "i", "j"]):
            doc, line, n, bits, first = (f[c].to_numpy() for c in ("doc", "line", "n", "bits", "first"))
            long = f["more"].notna().to_numpy()
            more = np.zeros((len(f), MORE), np.uint64)
            more[long] = np.frombuffer(b"".join(f["more"][long]), np.uint64).reshape(-1, MORE)
            bits, found = bits.view(np.uint64), []
            allowed = lambda both: both - 2 * np.ceil(threshold / (1 + threshold) * both - 1e-9)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = lo + np.flatnonzero(first[lo:hi]), lo + np.flatnonzero(~first[lo:hi])
                for low in range(0, len(a) if len(b) else 0, 256):
                    x = a[low : low + 256]
                    earlier = (doc[b] < doc[x][:, None]) | (doc[b] == doc[x][:, None]) & (line[b] < line[x][:, None])
                    alike = np.minimum.outer(n[x], n[b]) >= threshold * np.maximum.outer(n[x], n[b]) - 1e-9
                    i, j = np.nonzero(earlier & alike & (np.bitwise_count(bits[x][:, None] ^ bits[b]) <= allowed(np.add.outer(n[x], n[b]))))
                    i, j = x[i], b[j]
                    differ = np.where(long[i] & long[j], np.bitwise_count(more[i] ^ more[j]).sum(axis=1), np.bitwise_count(bits[i] ^ bits[j]))
                    ok = differ <= allowed(n[i] + n[j])
                    i, j, differ = i[ok], j[ok], differ[ok]
                    if not every:
                        order = np.lexsort((differ, i))
                        i, j = i[order], j[order]
                        new = np.append(True, i[1:] != i[:-1])[: len(i)]
                        i, j = i[new], j[new]
                    found.append((i, j))
            i, j = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            yield pd.DataFrame({"doc_a": doc[i], "line_a": line[i], "doc_b": doc[j], "line_b": line[j]})

    return tasks.mapInPandas(releasing(near), "doc_a long, line_a int, doc_b long, line_b int").distinct()


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 1, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """doc, line (from 0) of every line that matches an earlier line, in the order of (id, line).

    Lines match when the Jaccard similarity of their token sets is at least threshold. Equal sets are one class, with
    its first line. Classes that share a token of their prefixes (their rarest tokens) are candidates: of a token that up
    to FEW have, each with at most NEAR, one by one where the token is dealt; of others first with the earliest class that
    has it (the hub), then, for those without a match, with all earlier ones of that hub in blocks, so that no candidate
    is missed. Only pairs that sizes, places and bits of the sets allow are compared by their texts, which are read once.
    """
    integer_ids(df, id_col)
    with temporary() as keep:
        spark = df.sparkSession
        docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

        ranks, total = token_ranks(docs, words)
        known = spark.sparkContext.broadcast(ranks)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
        kind = "part int, kind int, longs binary, ints binary, more binary"
        dealt = docs.mapInArrow(releasing(lambda b: _prefixes(b, words, least, threshold, known.value, parts)), kind).repartitionById(parts, "part")
        dealt = dealt.mapInArrow(releasing(lambda b: _classes(b, parts)), kind).repartitionById(parts, "part")
        kinds = ", ".join(f"{k} {'int' if t == 'i4' else 'long'}" for k, t in _FOUND.items())
        found = stash(dealt.mapInArrow(releasing(lambda b: _shared(b, threshold)), kinds), "found")
        known.unpersist()
        again = keep(stash(found.where(F.col("kind") == _GONE).select("doc", "line"), "gone"))
        pair = ["doc_a", "line_a", "doc_b", "line_b"]
        few = found.where(F.col("kind") == _PAIR).withColumnsRenamed({"doc": "doc_a", "line": "line_a"}).repartition("doc_a", "line_a")
        few = few.groupBy(*pair).agg(F.min("differ").alias("differ"))
        order = F.row_number().over(Window.partitionBy("doc_a", "line_a").orderBy("differ", "doc_b", "line_b"))
        few = stash(few.select(*pair, order.alias("order")), "few")
        members = found.where(F.col("kind") == _TOKEN).select("token", "doc", "line", "n", "at", "bits")
        crowds = not members.isEmpty()
        if crowds:
            crowd = stash(_crowds(members, threshold), "crowd")
        discard(found)

        def ends(p: DataFrame) -> DataFrame:
            return p.select(*(F.col(f"{c}_a").alias(c) for c in ("doc", "line"))).union(p.select(*(F.col(f"{c}_b").alias(c) for c in ("doc", "line"))))

        # the texts of all candidates, from one reading of the documents, which stay where they are
        bits = asked_lines(ends(few).union(ends(crowd)) if crowds else ends(few))
        asked = spark.sparkContext.broadcast(bits)
        texts = docs.mapInArrow(releasing(lambda b: _picked(b, asked.value)), "doc long, line int, t string").dropDuplicates(["doc", "line"])
        texts = stash(texts, "texts")
        asked.unpersist()

        def without(rows: DataFrame, found: DataFrame) -> DataFrame:
            done = found.select(F.col("doc").alias("doc_a"), F.col("line").alias("line_a"), fresh_key("doc", "line").alias("j"))
            return rows.withColumn("j", fresh_key("doc_a", "line_a")).join(done, ["j", "doc_a", "line_a"], "left_anti").drop("j")

        def of_crowds(found: DataFrame, every: bool) -> DataFrame:
            done = found.select(F.col("doc").alias("doc_a"), F.col("line").alias("line_a"), F.lit(True).alias("done"), fresh_key("doc", "line").alias("j"))
            rows = crowd.drop("ok").withColumn("j", fresh_key("doc_a", "line_a")).join(done, ["j", "doc_a", "line_a"], "left").drop("j")
            rows = rows.withColumn("j", fresh_key("doc_a", "line_a")).join(more.withColumn("j", fresh_key("doc_a", "line_a")), ["j", "doc_a", "line_a"], "left").drop("j")
            return stash(_pairs_in_crowds(rows, threshold, every), "pairs")

        def verified(pairs: DataFrame) -> DataFrame:
            own = texts.join(F.broadcast(ends(pairs)), ["doc", "line"], "left_semi") if pairs.count() <= SENT else texts
            return keep(stash(_verified(pairs, own, words, threshold), "matched"))

        # the nearest candidate of each line, then, for lines still without a match, all
        matched = verified(few.where("order = 1").select(*pair))
        others = few.where("order > 1").select(*pair)
        if crowds:
            others = others.union(crowd.where("ok").select(*pair)).distinct()
        left = stash(without(others, matched), "left")
        discard(few)
        if not left.isEmpty():
            matched = matched.union(verified(left))
        if crowds:
            long = crowd.where(F.col("n_a") >= LONG).select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line"), fresh_key("doc_a", "line_a").alias("j"))
            long = texts.withColumn("j", fresh_key("doc", "line")).join(long, ["j", "doc", "line"], "left_semi").drop("j")
            more = stash(long.mapInPandas(releasing(lambda f: _more_bits(f, words)), "doc_a long, line_a int, more binary"), "bits")
            # in crowds: the nearest of each block, then, for lines still without a match, all
            for every in (False, True):
                pairs = of_crowds(matched, every)
                if pairs.isEmpty():
                    break
                matched = matched.union(verified(pairs))

        return again.union(matched).distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 1, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """df with text without the lines that match an earlier line, and columns n_lines, n_removed, kept.

    Lines end at a line feed. A line's tokens are its words in lower case (words: runs of so many; a line of fewer is then
    one token). Lines match from a Jaccard similarity of threshold on; the match in the row with the smaller id, or
    earlier in the same text, stays, and lines that go still make later ones go. Lines with fewer than least words
    stay (1: only blank lines). kept is false where all lines went.

    Null and empty texts stay as they are (null: n_lines 0). Rows with null id stay as they are and make no line go.
    Of rows that repeat an id, lines at the same place share their fate. Other columns pass through, whatever their
    names (n_lines, n_removed and kept are replaced). An empty table gives an empty result. Ids are integers.
    """
    doc, gone_, left_, lines_ = unused(df, "doc", "gone", "left", "lines")
    gone = repeated_lines(df, id_col, text_col, words, threshold, least)
    gone = gone.groupBy(F.col("doc").alias(doc)).agg(F.collect_list("line").alias(gone_))
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
    out = df.join(gone, df[id_col] == F.col(doc), "left").withColumn(left_, F.when(F.col(gone_).isNotNull(), left)).withColumn(lines_, F.when(F.col(gone_).isNotNull(), lines))
    feeds = F.octet_length(df[text_col]) - F.octet_length(F.replace(df[text_col], F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(feeds + 1)
    n_removed = F.when(F.col(left_).isNull(), 0).otherwise(n_lines - F.size(left_))
    text = F.when(F.col(left_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left_, lambda i: F.element_at(F.col(lines_), i + 1)), "\n"))
    names = [c for c in df.columns if c not in ("n_lines", "n_removed", "kept")]
    kept = ((n_lines > n_removed) | (n_removed == 0)).alias("kept")
    return out.select(*(text.alias(c) if c == text_col else df[c] for c in names), n_lines.alias("n_lines"), n_removed.alias("n_removed"), kept)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed", "kept")
