"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import mixed, release_memory, releasing

SPACE = "▁"
#: No piece spans a border of these units: spaces stand only before other letters, line feeds only alone.
_UNIT = re.compile(r" *[^ \n]+|\n| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A literal U+2581 in a text; no piece has it, so that it is spelled in bytes and comes back.
_LITERAL = 0x110000
_CHARS = 1_000_000
#: Units that are gone through one by one, when no more are left that are so long.
FEW = 8
#: Nodes of lattices that a task keeps (about 40 bytes each).
MOST_NODES = 750_000
_PLACE_BITS = 18


class Vocabulary:
    """Pieces of a model by length and hash. A piece's log weight is -log(2 + rank), rank being how late the model
    merged it; a byte has the rank of the whole vocabulary."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_weight = -float(np.log(2 + size))
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for c in piece:
                        h = h * _BASE + np.uint64(ord(c) + 1)
                by_length.setdefault(len(piece), []).append((int(h), i, -float(np.log(2 - min(0.0, model.get_score(i))))))
        self.table_of_bytes = np.array(self.bytes_of, object)
        self.longest = max(by_length)
        rows = [row for found in by_length.values() for row in found]
        self.keys, self.ids, self.weights = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int32, np.float64), strict=True))
        # a table of places by the top bits of a scrambled hash, and a sorted one for the few that share a place
        place = self.keys * _BASE >> np.uint64(64 - _PLACE_BITS)
        order = np.argsort(place, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = place[order][1:] != place[order][:-1]
        self.table = np.full(1 << _PLACE_BITS, -1, np.int32)
        self.table[place[order[first]]] = order[first]
        rest = order[~first]
        self.rest = rest[np.argsort(self.keys[rest])]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, or -1."""
        at = self.table[(h * _BASE >> np.uint64(64 - _PLACE_BITS)).astype(np.int64)]
        out = np.where(self.keys[at] == h, at, -1)
        other = np.flatnonzero((out < 0) & (at >= 0))
        if len(other) and len(self.rest):
            i = np.minimum(np.searchsorted(self.keys[self.rest], h[other]), len(self.rest) - 1)
            hit = self.keys[self.rest[i]] == h[other]
            out[other[hit]] = self.rest[i[hit]]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All segmentations of some units at once. Nodes are places between characters; the edges of a node, sorted by
    node, are pieces with the probability of being next, given that the rest of the unit follows in any way."""

    def __init__(self, units: list[str], vocab: Vocabulary) -> None:
        n = np.fromiter(map(len, units), np.int64, len(units))
        raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(raw == 32, ord(SPACE), np.where(raw == ord(SPACE), _LITERAL, raw))
        at = np.arange(len(raw)) + np.repeat(np.arange(len(n)), n)  # one more node at the end of each unit
        self.start = np.cumsum(n + 1) - (n + 1)
        nodes = len(raw) + len(n)
        room = np.repeat(np.cumsum(n), n) - np.arange(len(raw))
        found: list[tuple[np.ndarray, ...]] = []
        places, h, single = np.arange(len(raw)), np.zeros(len(raw), np.uint64), np.zeros(len(raw), bool)
        for length in range(1, vocab.longest + 1):
            fits = room[places] >= length
            places, h = places[fits], h[fits]
            if not len(places):
                break
            h = h * _BASE + (codes[places + length - 1] + 1).astype(np.uint64)
            i = vocab.find(h)
            hit = np.flatnonzero(i >= 0)
            found.append((at[places[hit]], length, vocab.ids[i[hit]], vocab.weights[i[hit]]))
            if length == 1:
                single[places[hit]] = True
        lone = np.flatnonzero(~single)  # characters without a piece are spelled in bytes
        spelled = 1 + (raw[lone] > 0x7F).astype(np.int64) + (raw[lone] > 0x7FF) + (raw[lone] > 0xFFFF)
        found.append((at[lone], 1, np.where(raw[lone] < 0x80, vocab.byte_ids[raw[lone] & 0x7F], -1 - raw[lone]), vocab.byte_weight * spelled))
        degree = np.zeros(nodes + 1, np.int64)
        for source, *_ in found:
            degree[source] += 1
        self.first = np.cumsum(degree) - degree
        self.target, self.piece, weight = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int32), np.empty(self.first[-1])
        slot = self.first.copy()
        for source, length, piece, w in reversed(found):  # long pieces first, which are the likelier ones
            e = slot[source]
            slot[source] += 1
            self.target[e], self.piece[e], weight[e] = source + length, piece, w

        left = np.zeros(nodes, np.int64)
        left[at] = room
        turn = np.argsort(left, kind="stable")
        turn = turn[left[turn] > 0]
        deg = degree[turn]
        end = np.cumsum(deg)
        order = np.repeat(self.first[turn] - (end - deg), deg) + np.arange(int(deg.sum()))
        beta, t, w = np.zeros(nodes), self.target[order], weight[order]
        levels = np.searchsorted(left[turn], np.arange(1, (left.max() if nodes else 0) + 2))
        for lo, hi in zip(levels[:-1], levels[1:], strict=True):
            if hi - lo < FEW:
                break
            i, j = end[lo] - deg[lo], end[hi - 1]
            x = w[i:j] + beta[t[i:j]]
            first = end[lo:hi] - deg[lo:hi] - i
            top = np.maximum.reduceat(x, first)
            beta[turn[lo:hi]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, deg[lo:hi])), first))
        else:
            lo = hi if len(levels) > 1 else 0
        self._few(beta, turn[lo:], deg[lo:], t[len(t) - int(deg[lo:].sum()) :], w[len(t) - int(deg[lo:].sum()) :])
        self.logp = weight + beta[self.target] - np.repeat(beta, degree[:-1])
        self.done = np.zeros(nodes, bool)
        self.done[self.start + n] = True

    def added(self, more: Lattice) -> None:
        """Appends the nodes and edges of more, in arrays with room to grow."""
        n, e = len(self.done), len(self.target)
        for name, own, at in (("first", more.first + e, n), ("done", more.done, n), ("target", more.target + n, e), ("piece", more.piece, e), ("logp", more.logp, e)):
            old = getattr(self, name)
            room = old.base if old.base is not None and len(old.base) >= at + len(own) else None
            if room is None:
                room = np.empty(2 * (at + len(own)), old.dtype)
                room[:at] = old[:at]
            room[at : at + len(own)] = own
            setattr(self, name, room[: at + len(own)])
        self.start = more.start + n

    @staticmethod
    def _few(beta: np.ndarray, turn: np.ndarray, degree: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """beta of the nodes in turn, one by one: few units are so long, so there is little to do at once."""
        known: dict[int, float] = {}
        e, t, w = 0, target.tolist(), weight.tolist()
        for node, d in zip(turn.tolist(), degree.tolist(), strict=True):
            x = []
            for k in range(e, e + d):
                b = known.get(t[k])
                x.append(w[k] + (beta.item(t[k]) if b is None else b))
            e += d
            top = max(x)
            known[node] = top + math.log(sum(math.exp(v - top) for v in x))
        if known:
            beta[list(known)] = list(known.values())

    def walk(self, node: int, key: np.uint64, sample: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(edges, a number in (0, 1) for each) of the rest of a random way from node to the end of its unit."""
        stop = node + int(np.argmax(self.done[node:]))
        base = int(self.first[node])
        first = (self.first[node : stop + 1] - base).tolist()
        p, target = np.exp(self.logp[base : int(self.first[stop])]).tolist(), self.target[base : int(self.first[stop])].tolist()
        edges, spare = [], []
        now = node
        while now < stop:
            h = _hashed(np.full(4096, key), sample << 32 | np.arange(step, step + 4096))
            u, other = _uniform(h).tolist(), _uniform(h, 1)
            n = 0
            while n < 4096 and now < stop:
                e, last, x = first[now - node], first[now - node + 1] - 1, u[n]
                x -= p[e]
                while x >= 0 and e < last:
                    e += 1
                    x -= p[e]
                edges.append(base + e)
                now = target[e]
                n += 1
            spare.append(other[:n])
            step += n
        return np.array(edges, np.int64), np.concatenate(spare) if spare else np.empty(0)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        e, last = self.first[node], self.first[node + 1] - 1
        u = u - np.exp(self.logp[e])
        more = np.flatnonzero((u >= 0) & (e < last))
        while len(more):
            e[more] += 1
            u[more] -= np.exp(self.logp[e[more]])
            more = more[(u[more] >= 0) & (e[more] < last[more])]
        return e

    def others(self, edges: list[int]) -> float:
        """Log of the probability of the edges of a node that aren't among edges."""
        lo, hi = self._around(edges[0])
        rest = [e for e in range(lo, hi) if e not in edges]
        return float(np.log(np.exp(self.logp[rest]).sum())) if rest else -np.inf

    def sibling(self, edges: list[int], u: float) -> int:
        lo, hi = self._around(edges[0])
        rest = [e for e in range(lo, hi) if e not in edges]
        c = np.cumsum(np.exp(self.logp[rest]))
        return rest[min(int(np.searchsorted(c, u * c[-1], side="right")), len(rest) - 1)]

    def _around(self, edge: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.first, edge, side="right")) - 1
        return int(self.first[i]), int(self.first[i + 1])


class Known:
    """The lattices of units met before, up to about MOST_NODES nodes; common words are built once."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.start, self.lattice = vocab, {}, Lattice([], vocab)

    def of(self, units: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """(a lattice that has the units, the first node of each)."""
        if len(self.lattice.done) > MOST_NODES:
            self.start, self.lattice = {}, Lattice([], self.vocab)
        new = [u for u in units if u not in self.start]
        if new:
            self.lattice.added(Lattice(new, self.vocab))
            self.start.update(zip(new, self.lattice.start.tolist(), strict=True))
        return self.lattice, np.fromiter(map(self.start.__getitem__, units), np.int64, len(units))


def _hashed(key: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.asarray(key, np.uint64) + _BASE * (np.asarray(salt).astype(np.uint64) + np.uint64(1)))


def _uniform(h: np.ndarray, half: int = 0) -> np.ndarray:
    """A number in (0, 1) from one half of a hash."""
    return ((h >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / (1 << 32)


def _below(mu: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with places mu, given that they are below top."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(mu == -np.inf, -np.inf, mu - np.log(np.exp(np.minimum(mu - top, 700)) - np.log(u)))


def _completed(lattice: Lattice, node: np.ndarray, key: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges in order, how many for each unit, a number in (0, 1) for each edge) of a random way from each node to
    the end of its unit. key: a hash for each unit."""
    steps, who, spare = [], [], []
    active, now = np.flatnonzero(~lattice.done[node]), node[~lattice.done[node]]
    while len(active) >= FEW:
        h = _hashed(key[active], sample << 32 | len(steps))
        e = lattice.draw(now, _uniform(h))
        steps.append(e)
        who.append(active)
        spare.append(_uniform(h, 1))
        now = lattice.target[e]
        go = ~lattice.done[now]
        active, now = active[go], now[go]
    count = np.zeros(len(node), np.int64)
    for w in who:
        count[w] += 1
    rest = [lattice.walk(int(x), key[i], sample, len(steps)) for i, x in zip(active, now, strict=True)]
    count[active] += np.fromiter((len(e) for e, _ in rest), np.int64, len(rest))
    at = np.cumsum(count) - count
    out, left = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()))
    for i, (e, w, u) in enumerate(zip(steps, who, spare, strict=True)):
        out[at[w] + i], left[at[w] + i] = e, u
    for i, (e, u) in zip(active, rest, strict=True):
        own = slice(at[i] + len(steps), at[i] + len(steps) + len(e))
        out[own], left[own] = e, u
    return out, count, left


def sample_segmentations(texts: list[str], keys: list[int], k: int, vocab: Vocabulary, store: Known | None = None) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, sample, piece ids, log probability, perturbed log probability, inclusion score) of the k distinct
    segmentations of each text whose Gumbel-perturbed log probabilities are largest.

    Top-down: the largest perturbed value of all segmentations goes down with the drawn piece at each node; the other
    pieces there, taken together, get the largest value of their own, drawn below it. The search then always opens
    the set with the largest value, as A* with an exact bound does. The inclusion score of a segmentation is its
    probability of being above the largest value left.
    """
    per_text = [_UNIT.findall(" " + t) if t else [] for t in texts]
    n_units = np.fromiter(map(len, per_text), np.int64, len(per_text))
    units = list(chain.from_iterable(per_text))
    unit, distinct = pd.factorize(np.array(units, object))
    lattice, begins = (Known(vocab) if store is None else store).of(distinct)
    begins = begins[unit]
    text = np.repeat(np.arange(len(texts)), n_units)
    key = np.array(keys, np.uint64)
    unit_start = np.cumsum(n_units) - n_units
    unit_key = _hashed(key[text], np.arange(len(unit)) - unit_start[text])

    edges, count, spare = _completed(lattice, begins, unit_key, 0)
    step_unit = np.repeat(np.arange(len(unit)), count)
    step_text = text[step_unit]
    bound = np.searchsorted(step_text, np.arange(len(texts) + 1))
    top = -np.log(-np.log(_uniform(_hashed(key, 1 << 40))))
    logp = lattice.logp[edges]
    run = np.cumsum(logp)
    before = run - logp - np.concatenate([[0.0], run])[bound[:-1]][step_text]
    with np.errstate(divide="ignore"):
        others = np.log(-np.expm1(np.minimum(logp, 0.0)))
    single = logp > -1e-12
    mu = np.where(single, -np.inf, before + others)
    value = _below(mu, top[step_text], spare)

    # A path of a text: its edges, the unit of each, the values of the sets beside them, the edges taken at a branch.
    paths: list[list] = [[] for _ in texts]
    found: list[list] = [[] for _ in texts]
    first = np.add.reduceat(np.append(logp, 0.0), np.minimum(bound[:-1], len(logp))) if len(texts) else []
    for d in range(len(texts)):
        if n_units[d]:
            at = slice(bound[d], bound[d + 1])
            paths[d].append((edges[at], step_unit[at], value[at], {}))
            found[d].append((edges[at], float(first[d]), float(top[d])))
    kappa = np.full(len(texts), -np.inf)
    for j in range(1, k + 1):
        branches = []
        for d in range(len(texts)):
            if len(found[d]) < j:
                continue
            e, units, values, taken = max(paths[d], key=lambda path: path[2].max())
            t = int(values.argmax())
            kappa[d] = values[t]
            if j == k or kappa[d] == -np.inf:
                continue
            h = _hashed(key[d], 1 << 41 | j)
            used = taken.setdefault(t, [int(e[t])])
            used.append(pick := lattice.sibling(used, float(_uniform(h))))
            ahead = float(lattice.logp[e[:t]].sum())
            values[t] = _below(np.array(ahead + lattice.others(used)), kappa[d], _uniform(h, 1))
            branches.append((d, e[:t], units[: t + 1], pick, ahead + float(lattice.logp[pick]), unit_start[d] + n_units[d]))
        if not branches:
            continue
        begin, end = np.array([b[2][-1] for b in branches]), np.array([b[5] for b in branches])
        size = end - begin
        after = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        node = begins[after]
        node[np.cumsum(size) - size] = lattice.target[[b[3] for b in branches]]
        new, c, spare = _completed(lattice, node, unit_key[after], j)
        new_units = np.repeat(after, c)
        cut = np.concatenate([[0], np.cumsum(np.add.reduceat(c, np.cumsum(size) - size))])
        who = np.repeat(np.arange(len(branches)), np.diff(cut))
        lp = lattice.logp[new]
        run = np.cumsum(lp)
        base = np.array([b[4] for b in branches]) - np.concatenate([[0.0], run])[cut[:-1]]
        with np.errstate(divide="ignore"):
            mu = np.where(lp > -1e-12, -np.inf, base[who] + run - lp + np.log(-np.expm1(np.minimum(lp, 0.0))))
        own = _below(mu, kappa[[b[0] for b in branches]][who], spare)
        for i, (d, head, units, pick, ahead, _) in enumerate(branches):
            at = slice(cut[i], cut[i + 1])
            path = np.concatenate([head, [pick], new[at]])
            paths[d].append((path, np.concatenate([units, new_units[at]]), np.concatenate([np.full(len(units), -np.inf), own[at]]), {}))
            found[d].append((path, ahead + float(lp[at].sum()), float(kappa[d])))
    for d in range(len(texts)):
        for j, (path, lp, g) in enumerate(found[d]):
            yield d, j, _ids(lattice.piece[path], vocab), lp, g, float(-np.expm1(-np.exp(min(lp - kappa[d], 700.0))))


def _ids(pieces: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Piece ids; a character of several bytes without a piece becomes the ids of its bytes."""
    spelled = np.flatnonzero(pieces < 0)
    if not len(spelled):
        return pieces
    parts, last = [], 0
    for i in spelled:
        parts += [pieces[last:i], vocab.byte_ids[list(chr(-1 - int(pieces[i])).encode("utf-8", "surrogatepass"))]]
        last = i + 1
    return np.concatenate([*parts, pieces[last:]])


def decoded(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of piece ids, without the space that encoding put before it."""
    return b"".join(vocab.table_of_bytes[ids].tolist())[1:].decode("utf-8", "surrogatepass")


def encode_samples(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 1, copy_col: str | None = None) -> DataFrame:
    """k rows for each row of df: id, sample (from 0), piece_ids, n_pieces, log_prob, perturbed, inclusion, round_trip.

    Each row is a distinct segmentation of the whole text, sampled without replacement with probabilities from the
    lattice of the model's pieces. The seed of a text is its id, so that reruns agree and rows don't depend on their
    neighbours. round_trip says that decoding gives the text. log_prob is normalised over all segmentations.

    copy_col, if given, has numbers from 1 on for rows that repeat an id; those above 1 are part of the seed.

    A text with fewer than k segmentations has one row for each (inclusion 1). Null and empty texts have one row, of
    no pieces (null: piece_ids null). Rows that repeat an id are sampled with the same seed. Null ids have a seed of
    their own. Characters without a piece are spelled in byte pieces. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        vocab = vocabulary(model)
        # of the task, not of the worker, which would hold it beside the arrays of other stages
        known = Known(vocab)
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            copies = b.column("copy").to_pylist()
            keys = [xxhash.xxh3_64_intdigest((f"{i}" if c <= 1 else f"{i}/{c}").encode(), seed) for i, c in zip(ids, copies, strict=True)]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= _CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                own = [t or "" for t in texts[lo:hi]]
                rows = [(lo + d, *row) for d, *row in sample_segmentations(own, keys[lo:hi], k, vocab, known)]
                none = np.empty(0, np.int64)
                rows += [(lo + d, 0, none, 0.0, 0.0, 1.0) for d, t in enumerate(own) if not t]
                ends = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]) if rows else np.zeros(1)
                flat = np.concatenate([none, *(r[2] for r in rows)]).astype(np.int32)
                gone = pa.array([texts[r[0]] is None for r in rows], pa.bool_())
                yield pa.record_batch(
                    {
                        "id": pa.array([ids[r[0]] for r in rows], b.schema.field("id").type),
                        "sample": pa.array([r[1] for r in rows], pa.int32()),
                        "piece_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=gone),
                        "n_pieces": pa.array([len(r[2]) for r in rows], pa.int32()),
                        "log_prob": pa.array([r[3] for r in rows], pa.float64()),
                        "perturbed": pa.array([r[4] for r in rows], pa.float64()),
                        "inclusion": pa.array([r[5] for r in rows], pa.float64()),
                        "round_trip": pa.array([decoded(r[2], vocab) == (texts[r[0]] or "") for r in rows], pa.bool_()),
                    }
                )
                lo = hi

    copy = F.coalesce(F.col(copy_col).cast("int"), F.lit(1)) if copy_col else F.lit(1)
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), copy.alias("copy"))
    out = out.mapInArrow(releasing(encoded), f"id {kind}, sample int, piece_ids array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", pieces_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """id and text of the piece ids of each row; null ids of pieces give a null text, none an empty one."""
    kind = df.schema[id_col].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for b in batches:
            out = [None if p is None else decoded(np.array(p, np.int64), vocab) for p in b.column("p").to_pylist()]
            yield pa.record_batch({"id": b.column("id"), "t": pa.array(out, pa.string())})

    return df.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("p")).mapInArrow(texts, f"id {kind}, t string").select(F.col("id").alias(id_col), F.col("t").alias(text_col))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    return encode_samples(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
