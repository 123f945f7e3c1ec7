"""SentencePiece encoding, decoding, and distinct sampled segmentations.

Plain encoding and decoding are the library's.  Sampling is Gumbel top-k without
replacement over the lattice of all segmentations, each weighted by the product
of its pieces' weights, by a search in the order of perturbed log-probabilities:

* The root, all segmentations, gets a Gumbel number.  It is the largest of its
  subtree, so it belongs to the segmentation reached by choosing every next
  piece by its conditional probability.
* Each step leaves a subtree: same pieces so far, another next one.  Its largest
  number is a Gumbel at the log of its mass, conditioned to stay below that of
  the path it left.
* The next sample is the open subtree with the largest number; it is descended
  alike and leaves subtrees of its own.  k pops are exactly the k segmentations
  with the largest perturbed log-probabilities: a sample without replacement.

The largest number still open after k pops is the threshold of the inclusion
score: a segmentation of log-probability p is in with probability
1 - exp(-exp(p - threshold)).

The lattice falls apart between two bytes that no piece holds side by side, as
before a space that follows a letter.  The parts, segments, repeat as words do:
a bounded store keeps the edges of those met so far, with the probability of
each as the next piece, from one batch to the next; a full store starts anew.
Draws step through all open segments of a batch together.  A segment longer than
``LONG`` bytes is not stored: its backward sums are computed once, and its edges
in windows as a draw passes.  Random numbers are hashes of the row's key, the
sample and the byte, so they don't depend on partitions, batches or the store.

Pieces weigh 1 / (rank + 10), their rank in the vocabulary's merge order: the
vocabulary has no probabilities of its own.  A character without a piece is its
UTF-8 byte pieces; so is a literal "▁", which else would come back as a space.

Defined results: a null or empty text has one segmentation without pieces;
equal rows with equal keys get equal samples; a text with fewer than k
segmentations gives all of them; a null key counts as zero; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import count
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix, slices

SAMPLES = 3
#: Bytes of text that are searched together; a longer text is searched alone.
SLICE = 512 << 10
SEED = 11
#: Added to a piece's rank; tempers the weights of the first merges.
RANK_OFFSET = 10
#: Bytes of segments that the store holds, at most, but for those of one window.
ROOM = 2 << 20
#: Segments that are looked up and stepped through together.
WINDOW = 1 << 17
#: Longer segments, in bytes, are not stored.
LONG = 256
#: Bytes of a long segment whose edges are held at a time.
STRETCH = 64 << 10
#: Pieces of a new path that are looked at first for the subtrees to open.
NEAR = 64
#: Below the logarithm of any exponential number that ``_unit`` can give.
_LEAST = -38.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@cache
def processor(path: str | None = None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))


def encode(text: str) -> list[int]:
    return processor().encode(text)


def decode(ids: list[int]) -> str:
    """The text of any segmentation: pieces joined, the leading mark of a first word dropped."""
    pieces = _vocabulary()[0]
    joined = b"".join(pieces[i] for i in ids)
    return joined[joined.startswith(b" ") :].decode("utf-8", "replace")


class Trie:
    """All pieces by their bytes; its transitions are one sorted table."""

    def __init__(self, pieces: list[tuple[bytes, int, float]]) -> None:
        children: dict[int, int] = {}
        ids, weights = [-1], [0.0]
        for piece, i, weight in pieces:
            node = 0
            for byte in piece:
                if (key := node << 8 | byte) not in children:
                    children[key] = len(ids)
                    ids.append(-1)
                    weights.append(0.0)
                node = children[key]
            ids[node], weights[node] = i, weight
        self.keys = np.array(sorted(children), np.int64)
        self.child = np.array([children[k] for k in self.keys.tolist()], np.int64)
        self.ids, self.weights = np.array(ids, np.int32), np.array(weights)
        self.root = np.full(256, -1, np.int64)
        self.root[self.keys[self.keys < 256]] = self.child[self.keys < 256]
        self.second = np.full(1 << 16, -1, np.int64)
        for byte, node in enumerate(self.root.tolist()):
            if node >= 0:
                lo, hi = np.searchsorted(self.keys, [node << 8, node + 1 << 8])
                self.second[byte << 8 | self.keys[lo:hi] & 255] = self.child[lo:hi]

    def match(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """The edges of every byte, those of one byte together: the bytes' bounds
        among them, and each edge's size, id (-1: a character spelled by its bytes)
        and log-weight.  ``limit`` is the bytes left at each byte; inner bytes of a
        character have no edges."""
        n = len(data)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = 1 + (data[lead] >= 0xC0).astype(np.int64) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        wide = np.zeros(n, np.int64)
        wide[lead] = width
        plain, counts, found = np.zeros(n, bool), np.zeros(n, np.int64), []
        node = self.root[data[lead]]
        at, node = lead[node >= 0], node[node >= 0]
        for size in count(1):
            hit = self.ids[node] >= 0
            places = at[hit]
            found.append((places, counts[places], size, self.ids[node[hit]], self.weights[node[hit]]))
            counts[places] += 1
            plain[places[wide[places] == size]] = True
            more = limit[at] > size
            at, node = at[more], node[more]
            if size == 1:
                node = self.second[data[at].astype(np.int64) << 8 | data[at + 1]]
                more = node >= 0
                at, node = at[more], node[more]
            else:
                key = node << 8 | data[at + size]
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                more = self.keys[slot] == key
                at, node = at[more], self.child[slot[more]]
            if not len(at):
                break
        spelled = lead[~plain[lead]]
        found.append((spelled, counts[spelled], wide[spelled], -1, _vocabulary()[3] * wide[spelled]))
        counts[spelled] += 1
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int32), np.empty(bounds[-1])
        for places, rank, *values in found:
            slot = bounds[places + 1] - 1 - rank  # long ones first: they are drawn most
            for column, value in zip(out, values):
                column[slot] = value
        return bounds, *out


@cache
def _vocabulary():
    """Bytes of each id; the trie of all but byte pieces; the first byte piece's id and log-weight."""
    sp = processor()
    size = sp.get_piece_size()
    pieces, known, first_byte = [b""] * size, [], None
    for i in range(size):
        if sp.is_byte(i):
            pieces[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
            first_byte = i if first_byte is None else first_byte
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
            known.append((pieces[i], i, -np.log(min(-sp.get_score(i), size) + RANK_OFFSET)))
    return pieces, Trie(known), first_byte, -np.log(size + RANK_OFFSET)


@cache
def _spellings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' bytes in a row, and each id's first byte there and length."""
    pieces = _vocabulary()[0]
    sizes = np.array(list(map(len, pieces)), np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


@cache
def _joins() -> np.ndarray:
    """Which two bytes, first << 8 | second, some piece holds side by side."""
    pieces, _, first_byte, _ = _vocabulary()
    out = np.zeros(1 << 16, bool)
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            out[a << 8 | b] = True
    return out


def decoded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that rows of ids spell, and the rows' bounds among them."""
    blob, first, sizes = _spellings()
    lengths = sizes[ids]
    ends = np.cumsum(lengths)
    data = blob[np.repeat(first[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return data, np.concatenate([[0], ends])[bounds]


class _Index(dict):
    """Segments' numbers; one that isn't there yet gets the next, but for long ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, segment: bytes) -> int:
        if len(segment) > LONG:
            return -1
        self.new.append(segment)
        self[segment] = number = len(self)
        return number

    def take_new(self) -> list[bytes]:
        new, self.new = self.new, []
        return new


class Lattice:
    """The store: segments met so far, the edges of their bytes and each edge's probability.

    Edges of a byte stand together, ``first`` is the first.  ``upto`` is the
    probability of an edge or one before it; beyond 1 at a byte's last edge.  The
    log-probability of an only edge is zero.  Edge 0 belongs to no byte.
    """

    def __init__(self) -> None:
        self.generation = -1
        self.clear()

    def clear(self) -> None:
        self.generation += 1
        self.index = _Index()
        self.begin = np.empty(0, np.int64)  # of each segment, its first byte in the store
        self.end = np.empty(0, np.int64)
        self.first = np.ones(1, np.int64)
        self.size, self.id = np.zeros(1, np.uint8), np.zeros(1, np.int32)
        self.logp, self.upto = np.zeros(1, np.float32), np.zeros(1)
        self.places = self.segments = 0
        self.edges = 1

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.empty(max(2 * len(old), at + len(values)), old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
            old = new
        old[at : at + len(values)] = values

    def look_up(self, blob: bytes, cuts: list[int]) -> np.ndarray:
        """The numbers of the segments of ``blob`` between the cuts, -1 for long ones; new ones are added."""

        def numbers() -> np.ndarray:
            segments = map(blob.__getitem__, map(slice, cuts, cuts[1:]))
            return np.fromiter(map(self.index.__getitem__, segments), np.int64, len(cuts) - 1)

        found, new = numbers(), self.index.take_new()
        if self.places and self.places + sum(map(len, new)) > ROOM:
            self.clear()
            found, new = numbers(), self.index.take_new()
        if new:
            self._add(new)
        return found

    def _add(self, new: list[bytes]) -> None:
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(new), np.uint8)
        n = len(data)
        left = np.repeat(ends, lengths) - np.arange(n)
        bounds, size, ids, weight = _vocabulary()[1].match(data, left)
        counts = np.diff(bounds)
        place = np.repeat(np.arange(n), counts)
        ahead = np.where(size == left[place], n, place + size)
        later = np.zeros(n + 1)  # the last is the end of any segment
        order = np.flatnonzero(counts)
        order = order[np.argsort(left[order], kind="stable")]
        starts = np.cumsum(counts[order]) - counts[order]
        edge = np.repeat(bounds[order] - starts, counts[order]) + np.arange(len(place))
        cuts = [0, *(np.flatnonzero(np.diff(left[order])) + 1).tolist(), len(order)]
        near, far = weight[edge], ahead[edge]
        ends_of = np.append(starts, len(edge))
        for lo, hi in zip(cuts, cuts[1:]):
            a, b = ends_of[lo], ends_of[hi]
            later[order[lo:hi]] = np.logaddexp.reduceat(near[a:b] + later[far[a:b]], starts[lo:hi] - a)
        logp = weight + later[ahead] - later[place]
        self._put("begin", self.segments, self.places + ends - lengths)
        self._put("end", self.segments, self.places + ends)
        self._put("first", self.places, self.edges + bounds)
        self._put("size", self.edges, size)
        self._put("id", self.edges, ids)
        self._put("logp", self.edges, logp)
        self._put("upto", self.edges, _upto(logp, bounds))
        self.segments += len(new)
        self.places += n
        self.edges += len(size)

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each place an edge."""
        return _pick(self.upto, self.first[at], u)


def _upto(logp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Running sums of the probabilities of each byte's edges, beyond 1 at the last."""
    out, counts = np.exp(logp), np.diff(bounds)
    at = bounds[:-1][counts > 1]
    ends = bounds[1:][counts > 1]
    while len(at):
        out[at + 1] += out[at]
        at = at + 1
        more = at + 1 < ends
        at, ends = at[more], ends[more]
    out[bounds[1:][counts > 0] - 1] = 2.0
    return out


def _pick(upto: np.ndarray, edge: np.ndarray, u: np.ndarray) -> np.ndarray:
    """From each first edge on, the first whose running sum exceeds u."""
    todo = np.flatnonzero(upto[edge] <= u)
    rest = u[todo]
    while len(todo):
        edge[todo] += 1
        more = upto[edge[todo]] <= rest
        todo, rest = todo[more], rest[more]
    return edge


class LongSegment:
    """A segment of any length: its backward sums, and its edges a stretch at a time."""

    def __init__(self, text: bytes) -> None:
        self.data = np.frombuffer(text, np.uint8)
        n = len(text)
        self.later = np.full(n + 1, -np.inf)
        self.later[n] = 0.0
        recent, scale = [1.0], 0.0  # sums of the bytes after the current one, divided by exp(scale)
        for lo in range((n - 1) // STRETCH * STRETCH, -1, -STRETCH):
            hi = min(lo + STRETCH, n)
            bounds, size, _, weight = self._edges(lo, hi)
            bounds, size, weight = bounds.tolist(), size.tolist(), np.exp(weight).tolist()
            later = [-np.inf] * (hi - lo)
            sums = [0.0] * (hi - lo) + recent
            for i in range(hi - lo - 1, -1, -1):
                total = 0.0
                for e in range(bounds[i], bounds[i + 1]):
                    total += weight[e] * sums[i + size[e]]
                if total:
                    later[i] = log(total) + scale
                    if total < 1e-200:
                        for j in range(i + 1, min(i + 40, len(sums))):
                            sums[j] *= 1e200
                        total *= 1e200
                        scale -= 200 * log(10)
                    sums[i] = total
            self.later[lo:hi] = later
            recent = sums[:40]

    def _edges(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Edges of the bytes from ``lo`` up to ``hi``."""
        end = min(hi + 40, len(self.data))
        bounds, size, ids, weight = _vocabulary()[1].match(self.data[lo:end], end - np.arange(lo, end))
        last = bounds[hi - lo]
        return bounds[: hi - lo + 1], size[:last], ids[:last], weight[:last]

    def edges(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Bounds, size, id and log-probability."""
        bounds, size, ids, weight = self._edges(lo, hi)
        counts = np.diff(bounds)
        place = np.repeat(np.arange(lo, hi), counts)
        logp = weight + self.later[place + size] - self.later[place]
        return bounds, size, ids, np.where(np.repeat(counts, counts) > 1, logp, 0.0)

    def descend(self, at: int, seed: np.uint64, base: int) -> tuple[np.ndarray, ...]:
        """Byte, size, id and log-probability of drawn pieces from byte ``at`` on."""
        parts = []
        while at < len(self.data):
            hi = min(at + STRETCH, len(self.data))
            bounds, size, ids, logp = self.edges(at, hi)
            some = np.flatnonzero(np.diff(bounds))
            edge = np.zeros(hi - at, np.int64)
            edge[some] = _pick(_upto(logp, bounds), bounds[some], _unit(seed, base + at + some))
            ahead, path, i = (np.arange(hi - at) + size[edge]).tolist(), [], 0
            while i < hi - at:
                path.append(i)
                i = ahead[i]
            path = np.array(path)
            e = edge[path]
            parts.append((path + at, size[e], ids[e], logp[e]))
            at += i
        return tuple(map(np.concatenate, zip(*parts))) if parts else (np.empty(0, np.int64),) * 4


def _hashed(*parts) -> np.ndarray:
    """A 64-bit hash of the parts alone."""
    value = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for part in parts:
            value = mix(value * _GOLDEN + np.asarray(part).astype(np.uint64) + np.uint64(1))
    return value


def _unit(seed, at) -> np.ndarray:
    """Numbers within (0, 1) that depend on the seed and the byte alone."""
    with np.errstate(over="ignore"):
        value = mix(seed + (np.asarray(at).astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    return ((value >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class _Path:
    """One sample of a text: what it shares with its parent, and pieces of its own."""

    number: float
    before: float  # log-probability of the shared pieces
    parts: list[tuple[int, int, int]]  # round and pieces within it; the last are its own
    logp: float = 0.0


@dataclass
class _Text:
    """The open subtrees of one text's segmentations, and the paths found so far."""

    number: float  # of the next sample
    node: tuple[int, int] | None = None  # the path it leaves and the piece that it doesn't take
    paths: list[_Path] = field(default_factory=list)
    open: list[tuple[float, int, int]] = field(default_factory=list)
    taken: dict[tuple[int, int], tuple[int, ...]] = field(default_factory=dict)  # sizes of edges at a node that are paths already


@dataclass
class _Round:
    """The pieces drawn for one sample of all texts: byte in the text, size, id, log-probability."""

    byte: np.ndarray
    size: np.ndarray
    id: np.ndarray
    logp: np.ndarray


_store = cache(Lattice)


class _Batch:
    """Texts that are searched together, cut into segments."""

    def __init__(self, keys: list, texts: list[bytes]) -> None:
        self.blob = b"".join(b" " + t if t else b"" for t in texts)
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(self.blob, np.uint8)
        start = np.zeros(len(data), bool)
        for lo in range(1, len(data), SLICE):
            part = data[lo - 1 : lo + SLICE]
            start[lo : lo + SLICE] = ~_joins()[part[:-1].astype(np.uint16) << 8 | part[1:]] & ((part[1:] & 0xC0) != 0x80)
        start[self.offsets[:-1][sizes > 0]] = True
        self.bounds = np.append(np.flatnonzero(start), len(data))
        self.rows = np.searchsorted(self.bounds, self.offsets)  # each text's bounds among the segments
        self.key = np.array([k or 0 for k in keys], np.int64).astype(np.uint64)
        self.known: dict[int, tuple[int, np.ndarray]] = {}
        self.long: dict[int, LongSegment] = {}

    def segment(self, s: int) -> bytes:
        return self.blob[self.bounds[s] : self.bounds[s + 1]]

    def long_segment(self, s: int) -> LongSegment:
        if s not in self.long:
            if sum(len(x.data) for x in self.long.values()) > ROOM:
                self.long.clear()
            self.long[s] = LongSegment(self.segment(s))
        return self.long[s]

    def numbers(self, window: int) -> np.ndarray:
        """The store's numbers of the segments of a window."""
        held = self.known.get(window)
        if held is None or held[0] != _store().generation:
            cuts = self.bounds[window * WINDOW : (window + 1) * WINDOW + 1].tolist()
            found = _store().look_up(self.blob, cuts)
            self.known = {window: (_store().generation, found)}
        return self.known[window][1]

    def edges_at(self, text: int, byte: int) -> tuple[int, list[int], list[int], list[float]]:
        """The segment at a byte of a text, and the sizes, ids and log-probabilities of the edges there."""
        at = int(self.offsets[text]) + byte
        s = int(np.searchsorted(self.bounds, at, side="right")) - 1
        within = at - int(self.bounds[s])
        if self.bounds[s + 1] - self.bounds[s] > LONG:
            _, *found = self.long_segment(s).edges(within, within + 1)
        else:
            store = _store()
            number = store.look_up(self.blob, self.bounds[s : s + 2].tolist())[0]
            place = int(store.begin[number]) + within
            lo, hi = store.first[place], store.first[place + 1]
            found = store.size[lo:hi], store.id[lo:hi], store.logp[lo:hi].astype(np.float64)
        return s, *(c.tolist() for c in found)

    def descend(self, texts: np.ndarray, first: np.ndarray, skip: np.ndarray, seed: np.ndarray, given: list[tuple | None]) -> tuple[_Round, np.ndarray]:
        """Draw pieces for the texts from segment ``first`` and ``skip`` bytes on, after
        the ``given`` pieces.  Also the texts' bounds among the pieces."""
        last = self.rows[texts + 1]
        parts, counts = [], np.zeros(len(texts), np.int64)
        for w in range(int(first.min()) // WINDOW, (int(last.max()) - 1) // WINDOW + 1):
            lo, hi = np.maximum(first, w * WINDOW), np.minimum(last, (w + 1) * WINDOW)
            some = np.flatnonzero(hi > lo)
            spans = (hi - lo)[some]
            of = np.repeat(some, spans)
            seg = np.repeat(lo[some] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            pieces, n = self._window(w, seg, np.where(seg == first[of], skip[of], 0), seed[of], self.offsets[texts[of]])
            here = np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)
            opening = [i for i, piece in enumerate(given) if piece and first[i] // WINDOW == w]
            if opening:
                at = (np.cumsum(here) - here)[opening]
                pieces = [np.insert(c, at, [given[i][j] for i in opening]) for j, c in enumerate(pieces)]
                here[opening] += 1
            parts.append((pieces, here))
            counts += here
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if len(parts) == 1:
            return _Round(*parts[0][0]), bounds
        columns, done = [np.empty(bounds[-1], c.dtype) for c in parts[0][0]], bounds[:-1].copy()
        for pieces, here in parts:
            where = np.repeat(done - (np.cumsum(here) - here), here) + np.arange(here.sum())
            for column, c in zip(columns, pieces):
                column[where] = c
            done += here
        return _Round(*columns), bounds

    def _window(self, w: int, seg: np.ndarray, skip: np.ndarray, seed: np.ndarray, offset: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The pieces of segments of one window, each from ``skip`` bytes on, and how many each has."""
        number, store = self.numbers(w)[seg - w * WINDOW], _store()
        stored = np.flatnonzero(number >= 0)
        begin, end = store.begin[number[stored]], store.end[number[stored]]
        at, byte = begin + skip[stored], self.bounds[seg[stored]] - offset[stored] + skip[stored]
        counts, steps = np.zeros(len(seg), np.int64), []
        more, whole_seed, seed = np.flatnonzero(at < end), seed, seed[stored]
        while len(more):
            stored, at, byte, end, seed = stored[more], at[more], byte[more], end[more], seed[more]
            edge = store.draw(at, _unit(seed, byte))
            steps.append((stored, edge, byte))
            counts[stored] += 1
            size = store.size[edge]
            at, byte = at + size, byte + size
            more = np.flatnonzero(at < end)
        longs = []
        for i in np.flatnonzero(number < 0).tolist():
            where = int(self.bounds[seg[i]] - offset[i])
            found, *rest = self.long_segment(int(seg[i])).descend(int(skip[i]), whole_seed[i], where)
            longs.append((i, found + where, *rest))
            counts[i] = len(found)
        first = np.cumsum(counts) - counts
        edge, byte = np.zeros(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
        for step, (live, e, b) in enumerate(steps):
            where = first[live] + step
            edge[where], byte[where] = e, b
        columns = [byte, store.size[edge], store.id[edge], store.logp[edge]]
        for i, *values in longs:
            for column, value in zip(columns, values):
                column[first[i] : first[i] + counts[i]] = value
        return columns, counts


def _branch(batch: _Batch, text: int, search: _Text, rounds: list[_Round], seed: np.uint64) -> tuple[int, int, tuple]:
    """The segment of the next sample's first own piece, the bytes of it that this
    piece ends at, and the piece: byte, size, id, log-probability."""
    path, at = search.node
    number = search.paths[path].parts[-1][0]
    byte = int(rounds[number].byte[at])
    s, sizes, ids, logps = batch.edges_at(text, byte)
    taken = search.taken[search.node]
    open_ = [i for i, size in enumerate(sizes) if size not in taken]
    chances = np.cumsum(np.exp([logps[i] for i in open_]))
    pick = open_[min(int(np.searchsorted(chances, float(_unit(seed, byte)) * chances[-1], side="right")), len(open_) - 1)]
    end = byte + int(batch.offsets[text]) - int(batch.bounds[s]) + sizes[pick]
    return s, end, (byte, sizes[pick], ids[pick], logps[pick])


def sample_batch(keys: list, texts: list[bytes], k: int) -> list[list[tuple]]:
    """Per text its samples in falling order: (perturbed, log-probability, log inclusion, ids)."""
    batch, rounds = _Batch(keys, texts), []
    searches = [_Text(float(top)) for top in -np.log(-np.log(_unit(_hashed(batch.key, 0xFFFF), 0)))]
    for sample in range(k):
        todo = [i for i, search in enumerate(searches) if search.number > -np.inf and len(texts[i])]
        if not todo:
            break
        active = np.array(todo)
        seeds = [_hashed(batch.key[active], sample, purpose) for purpose in range(3)]
        first, skip, given = batch.rows[active], np.zeros(len(todo), np.int64), [None] * len(todo)
        for j, i in enumerate(todo):
            if searches[i].node:
                first[j], skip[j], given[j] = _branch(batch, i, searches[i], rounds, seeds[1][j])
        drawn, bounds = batch.descend(active, first, skip, seeds[0], given)
        rounds.append(drawn)
        _open(searches, todo, given, rounds, bounds, seeds[2], k - sample, batch)
    for search, text in zip(searches, texts):
        if not text and k:
            search.paths.append(_Path(search.number, 0.0, []))
            search.number = -np.inf
    return _results(batch, searches, rounds)


def _race(logp: np.ndarray, rest: np.ndarray, byte: np.ndarray, shared: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """For each piece of the rows, log(E / m): E the exponential number and m the mass of the subtree it leaves.

    The subtree's Gumbel number, below that of the path, is -logaddexp(-path, log(E / m)).
    """
    before = np.cumsum(logp, axis=1) - logp + shared[:, None]
    with np.errstate(divide="ignore"):
        return np.where(rest > 0, np.log(-np.log(_unit(seed[:, None], byte))) - before - np.log(rest), np.inf)


def _open(searches: list[_Text], todo: list[int], given: list, rounds: list[_Round], bounds: np.ndarray, seed: np.ndarray, wanted: int, batch: _Batch) -> None:
    """Add the paths of a round, open the subtrees they leave, and go to each text's next sample.

    A subtree's mass falls from piece to piece, so the largest numbers are among the
    first: those of ``NEAR`` pieces are computed, and the others where they could matter.
    """
    drawn = rounds[-1]
    shared, lefts = np.zeros(len(todo)), np.full(len(todo), -1.0)
    for j, (i, piece) in enumerate(zip(todo, given)):
        search, lo, hi = searches[i], int(bounds[j]), int(bounds[j + 1])
        parts = []
        if piece:
            path, at = search.node
            parent = search.paths[path]
            number, start, _ = parent.parts[-1]
            shared[j] = parent.before + float(rounds[number].logp[start:at].sum(dtype=np.float64))
            parts = [*parent.parts[:-1], (number, start, at)]
            taken = (*search.taken[search.node], piece[1])
            search.taken[len(search.paths), lo] = taken
            _, sizes, _, logps = batch.edges_at(i, piece[0])
            lefts[j] = sum(np.exp(logp) for size, logp in zip(sizes, logps) if size not in taken)
        search.paths.append(_Path(search.number, shared[j], [*parts, (len(rounds) - 1, lo, hi)], shared[j] + float(drawn.logp[lo:hi].sum(dtype=np.float64))))

    def race(rows: np.ndarray, width: int) -> np.ndarray:
        at = np.minimum(bounds[rows][:, None] + np.arange(width), bounds[rows + 1][:, None] - 1)
        inside = np.arange(width) < (bounds[rows + 1] - bounds[rows])[:, None]
        logp = np.where(inside, drawn.logp[at].astype(np.float64), 0.0)
        rest = -np.expm1(logp)
        rest[:, 0] = np.where(lefts[rows] >= 0, lefts[rows], rest[:, 0])
        return np.where(inside, _race(logp, rest, drawn.byte[at], shared[rows], seed[rows]), np.inf)

    raced = race(np.arange(len(todo)), NEAR)
    some = min(wanted, NEAR) - 1
    worst = np.partition(raced, some, axis=1)[:, some]  # what a further piece must undercut, which it can't where its mass is this low
    falls = -np.cumsum(drawn.logp, dtype=np.float64)
    reach = np.searchsorted(falls, falls[bounds[:-1]] + shared + worst - _LEAST + 1) - bounds[:-1] + 1
    reach = np.minimum(reach, np.diff(bounds))
    found = list(raced)
    width = NEAR
    while (reach > width).any():
        width *= 2
        rows = np.flatnonzero((reach > width // 2) & (reach <= width))
        for at in range(0, len(rows), max(1, SLICE // width)):
            part = rows[at : at + max(1, SLICE // width)]
            for j, values in zip(part.tolist(), race(part, width)):
                found[j] = values
    for j, i in enumerate(todo):
        search, path, lo, mine = searches[i], len(searches[i].paths) - 1, int(bounds[j]), found[j]
        best = np.argpartition(mine, wanted - 1)[:wanted] if wanted < len(mine) else np.arange(len(mine))
        for q in best.tolist():
            if mine[q] < np.inf:
                search.taken.setdefault((path, lo + q), (int(drawn.size[lo + q]),))
                heapq.heappush(search.open, (float(np.logaddexp(-search.number, mine[q])), path, lo + q))
        if search.open:
            number, path, place = heapq.heappop(search.open)
            search.number, search.node = -number, (path, place)
        else:
            search.number = -np.inf


def _results(batch: _Batch, searches: list[_Text], rounds: list[_Round]) -> list[list[tuple]]:
    data, first_byte, offsets = np.frombuffer(batch.blob, np.uint8), _vocabulary()[2], batch.offsets
    spelt = []  # per round the ids, and where each piece's begin among them
    for number, drawn in enumerate(rounds):
        widths = np.where(drawn.id < 0, drawn.size, 1).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(widths)])
        ids = drawn.id
        if (ids < 0).any():
            of = np.repeat(np.arange(len(ids)), widths)
            text = np.zeros(len(ids), np.int64)
            for i, search in enumerate(searches):
                for path in search.paths:
                    if path.parts and path.parts[-1][0] == number:
                        text[path.parts[-1][1] : path.parts[-1][2]] = offsets[i]
            ids = np.where(ids[of] < 0, first_byte + data[(text + drawn.byte)[of] + np.arange(len(of)) - ends[of]].astype(np.int32), ids[of])
        spelt.append((ids, ends))
    none, out = np.empty(0, np.int32), []
    for search in searches:
        out.append([])
        for path in search.paths:
            ids = [spelt[number][0][spelt[number][1][lo] : spelt[number][1][hi]] for number, lo, hi in path.parts]
            gap = path.logp - search.number
            inclusion = gap if gap < -30 else 0.0 if gap > 30 else float(np.log(-np.expm1(-np.exp(gap))))
            out[-1].append((path.number, path.logp, inclusion, np.concatenate(ids) if ids else none))
    return out


_SAMPLED = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean"


def _sampled(k: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            found = sample_batch(batch.column("doc_id").to_pylist(), texts, k)
            of = np.repeat(np.arange(len(texts)), list(map(len, found)))
            rows = [s for samples in found for s in samples]
            ids = [s[3] for s in rows]
            bounds = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int64)
            every = np.concatenate(ids) if ids else np.empty(0, np.int32)
            data, cuts = decoded(every, bounds)
            back, raw = data.tobytes(), every.astype("<u4").tobytes()
            cuts, ends = cuts.tolist(), (4 * bounds).tolist()
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(of)),
                "sample": pa.array([j for samples in found for j in range(len(samples))], pa.int32()),
                "n_pieces": pa.array(np.diff(bounds)),
                **{name: pa.array([s[j] for s in rows], pa.float64()) for name, j in (("log_prob", 1), ("perturbed", 0), ("log_inclusion", 2))},
                "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                "round_trip": pa.array([back[a + 1 : b] == texts[i] for i, a, b in zip(of.tolist(), cuts, cuts[1:])], pa.bool_()),
            }
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(every, pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, keep_ids: bool = False) -> DataFrame:
    """k distinct segmentations of every text, without replacement.

    Columns: doc_id, sample (0: largest number), n_pieces, log_prob, perturbed,
    log_inclusion, ids_crc32 (little-endian unsigned 32-bit), round_trip (decoding
    gives the text back), and ids with ``keep_ids``.
    """
    return id_text(docs).mapInArrow(_sampled(k, keep_ids), _SAMPLED + (", ids array<int>" if keep_ids else ""))


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id and ids, the library's own segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            ids = processor().encode(batch.column("text").to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame) -> DataFrame:
    """doc_id and text of rows of doc_id and ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
