"""Context-mixing range coder for sequences of token ids, in independent blocks.

A segment (``pack``/``unpack``) is cut into blocks of ``BLOCK`` ids.  Every
block starts from the same model and has its own code stream, so blocks can be
coded side by side: all arrays below have one row per step and one column
(lane) per block, and step ``t`` codes the ``t``-th id of every block.

Order 0 predicts ids by the frequencies of the whole segment, which stand in
its head: a block is too short to learn those of a vocabulary.  Order 1 and
order 2 each predict one id: the last one seen in the block after the same id,
or the same two ids, with a class that tells how often in a row the prediction
held.  For each order and class, hits among trials give the probability that
such a prediction is right.  The three are mixed into one distribution: order
2 gets its probability of a range, order 1 its own of what is left (nothing
where both predict the same id), order 0 the rest.  Predicted ids follow every
step; probabilities are worked out anew every few steps (``_chunks``).

Coder: range coder with ranges up to 52 bits that puts out 24-bit words;
carries are added to the words before when all are known.  Ranges and codes
are whole numbers in doubles, which hold them exactly.

Segment layout, little-endian: magic ``TIDS``, uint32 version, number of ids,
ids per block, number of blocks, length of the table of frequencies; that
table (deflated: the distinct ids as uint16 differences, then their counts as
uint32); for each block uint32 number of words and CRC-32 of its ids as uint32;
the words of all blocks, three bytes each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TIDS", 4
BLOCK = 2048
#: Blocks that are coded side by side, about.
LANES = 3072
MAX_LANES = (1 << 12) - 1         # an entry of ``_Model.seen`` tells so many apart
MAX_ID = (1 << 16) - 2

_SLOTS = 1 << 10                  # places of an order's table in a lane
_SCALE = 22                       # bits of an order 0 share
_ONE = 1 << _SCALE
_WORD = 24                        # bits of a word; the first range holds two
_LEAST_RANGE, _LOW = float(1 << 28), (1 << _WORD) - 1
#: least share of an id in order 0; with the largest share that the others
#: take (see ``_MOST``), every range goes back over the least with one word
_LEAST = 16
#: least and first probabilities of a prediction by class (0: none yet), in
#: 64ths, and the largest ones; by order
_GUESS = np.array([[0, 4, 20, 40], [0, 20, 45, 58]])
_MOST = np.array([1 / 2, 7 / 8])
_RARE = 1 / 1024


def _chunks(steps: int) -> list[tuple[int, int]]:
    """Runs of steps in which all probabilities stay as they are."""
    at = [t for t in sorted({0, 4, 8, *range(16, steps, 16)}) if t < steps] + [steps]
    return list(zip(at, at[1:]))


class _Model:
    """The tables of both orders lie side by side: order 1 in the first
    ``lanes`` columns, order 2 in the others.  An entry of ``seen`` is an id
    and, above its 16 bits, the cell of the prediction's class and column."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        column = np.arange(2 * lanes, dtype=np.int32)
        self.base = np.arange(2 * lanes) * _SLOTS
        self.seen = np.repeat(column << 16, _SLOTS)
        self.next = np.int32(2 * lanes << 16)
        self.first, self.last = (np.int32(c) * self.next + (column << 16) for c in (1, 3))
        self.trials, self.hits = np.zeros(8 * lanes, np.int64), np.zeros(8 * lanes, np.int64)
        self.right = np.zeros((4, 2 * lanes))

    def refresh(self) -> None:
        """Probabilities from all that was seen so far."""
        n, h = (x.reshape(4, -1)[1:] for x in (self.trials, self.hits))
        guess = np.repeat(_GUESS[:, 1:].T, self.lanes, axis=1)
        self.right[1:] = np.clip((h * 16 + guess) / (n * 16 + 64), _RARE, np.repeat(_MOST, self.lanes))

    def slots(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Places in ``seen`` after the ids ``before`` and ``before2``."""
        at = np.empty((*before.shape[:-1], 2 * self.lanes), np.int64)
        one, two = at[..., :self.lanes], at[..., self.lanes:]
        one[:] = before
        np.multiply(before2, 421, out=two)
        two += before
        at &= _SLOTS - 1
        at += self.base
        return at

    def renew(self, at: np.ndarray, found: np.ndarray, hit: np.ndarray, twice: np.ndarray) -> None:
        """``twice``: the step's ids, once for each order."""
        held = np.minimum(found + self.next, twice + self.last)
        self.seen[at] = np.where(hit, held, twice + self.first)

    def tally(self, cells: np.ndarray, hit: np.ndarray) -> None:
        self.trials += np.bincount(cells.reshape(-1), minlength=len(self.trials))
        self.hits += np.bincount(cells[hit], minlength=len(self.hits))


def _cumulated(counts: np.ndarray) -> np.ndarray:
    """Borders of the ids' shares of order 0, from 0 to ``_ONE``."""
    below = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    n = len(counts)
    return below * (_ONE - _LEAST * n) // below[-1] + _LEAST * np.arange(n + 1)


def _encode(ids: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids``: lanes x steps, as places among the segment's distinct ids.
    Words of all lanes and how many each has."""
    lanes, steps = ids.shape
    model = _Model(lanes)
    padded = np.zeros((steps + 2, lanes), np.int32)
    padded[2:] = ids.T
    below, share = cum[:-1].astype(float), np.diff(cum).astype(float)
    low, rng = np.zeros(lanes), np.full(lanes, float(1 << 2 * _WORD))
    top, out = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), bool)
    for a, b in _chunks(steps):
        model.refresh()
        x = padded[a + 2:b + 2].astype(np.int64)
        at = model.slots(padded[a + 1:b + 1], padded[a:b])
        twice = np.concatenate([x, x], axis=1).astype(np.int32)
        found = np.empty((b - a, 2 * lanes), np.int32)
        hit = np.empty((b - a, 2 * lanes), bool)
        for k in range(b - a):
            found[k] = model.seen.take(at[k])
            np.equal(found[k] & 0xFFFF, twice[k], out=hit[k])
            model.renew(at[k], found[k], hit[k], twice[k])
        cells = found >> 16
        p = model.right.reshape(-1).take(cells)
        p1, p2 = p[:, :lanes], p[:, lanes:]
        p1 *= (found[:, :lanes] ^ found[:, lanes:]) & 0xFFFF != 0
        two = hit[:, lanes:] & (p2 > 0)
        one = hit[:, :lanes] & (p1 > 0) & ~two
        rest = ~(two | one)
        start, width = below.take(x) * rest, share.take(x) * rest
        # parts of the ranges of order 2 and 1 that lie below the id's own, or are it
        under2, in2, under1, in1 = (m.astype(float) for m in (~two, two, rest, one))
        for k in range(b - a):
            w2 = np.floor(rng * p2[k])
            rng -= w2
            w1 = np.floor(rng * p1[k])
            rng -= w1
            r = np.floor(rng * (1 / _ONE))
            low += w2 * under2[k] + w1 * under1[k] + r * start[k]
            rng = w2 * in2[k] + w1 * in1[k] + r * width[k]
            small = np.less(rng, _LEAST_RANGE, out=out[a + k])
            word = np.floor(low * (1 / (1 << _WORD)))
            top[a + k] = word
            word *= small
            low -= word * (1 << _WORD)
            shift = small * float(_LOW) + 1
            low *= shift
            rng *= shift
        model.tally(cells, hit)
    word = np.floor(low * (1 / (1 << _WORD)))
    last = np.stack([word, low - word * (1 << _WORD)]).astype(np.int32)
    top, out = np.concatenate([top, last]).T, np.concatenate([out, np.ones((2, lanes), bool)]).T
    words = top[out]
    while (carry := words >> _WORD).any():
        words &= _LOW
        words[:-1] += carry[1:]
    return words, out.sum(1)


def _decode(words: np.ndarray, n_words: np.ndarray, cum: np.ndarray, steps: int) -> np.ndarray:
    """The ids of ``_encode``, lanes x steps."""
    lanes = len(n_words)
    model, out = _Model(lanes), np.zeros((steps + 2, lanes), np.int32)
    words = words.astype(float)
    at = np.cumsum(n_words) - n_words + 2
    code = words.take(at - 2) * (1 << _WORD) + words.take(at - 1, mode="clip")
    rng = np.full(lanes, float(1 << 2 * _WORD))
    below, share = cum[:-1].astype(float), np.diff(cum)
    place, share = np.repeat(np.arange(len(share), dtype=np.uint16), share), share.astype(float)
    twice, right = np.empty(2 * lanes, np.int32), model.right.reshape(-1)
    kept, hits = np.empty((16, 2 * lanes), np.int32), np.empty((16, 2 * lanes), bool)
    for a, b in _chunks(steps):
        model.refresh()
        for t in range(a, b):
            slot = model.slots(out[t + 1], out[t])
            found = model.seen.take(slot)
            ids, cells, hit = found & 0xFFFF, kept[t - a], hits[t - a]
            np.right_shift(found, 16, out=cells)
            p = right.take(cells)
            p1, p2, id1, id2 = p[:lanes], p[lanes:], ids[:lanes], ids[lanes:]
            p1 *= id1 != id2
            w2 = np.floor(rng * p2)
            rng -= w2
            w1 = np.floor(rng * p1)
            rng -= w1
            r = np.floor(rng * (1 / _ONE))
            after2 = code - w2
            after1 = after2 - w1
            # all quotients are of numbers up to 2 ** 52, so doubles give their whole part exactly
            x = place.take(np.true_divide(after1, r).astype(np.int64), mode="clip").astype(np.int64)
            rest = after1 - r * below.take(x)
            width = r * share.take(x)
            for mask, i, c, w in ((after1 < 0, id1, after2, w1), (after2 < 0, id2, code, w2)):
                np.copyto(x, i, where=mask)
                np.copyto(rest, c, where=mask)
                np.copyto(width, w, where=mask)
            small = width < _LEAST_RANGE
            shift = small * float(_LOW) + 1
            rng = width * shift
            code = rest * shift + words.take(at, mode="clip") * small
            at += small
            out[t + 2] = x
            twice[:lanes] = x
            twice[lanes:] = x
            np.equal(ids, twice, out=hit)
            model.renew(slot, found, hit, twice)
        model.tally(kept[:b - a], hits[:b - a])
    return out[2:].T


def _groups(lanes: int) -> list[tuple[int, int]]:
    """Lanes in equal groups of about ``LANES``."""
    n = max(1, round(lanes / LANES), -(-lanes // MAX_LANES))
    edges = [lanes * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment of any number of ids (0 to ``MAX_ID``)."""
    n = len(ids)
    if n and int(ids.max()) > MAX_ID:
        raise ValueError(f"ids above {MAX_ID} have no code")
    block = max(1, min(block, n))
    lanes = -(-n // block)
    head = MAGIC + struct.pack("<IIII", VERSION, n, block, lanes)
    if not n:
        return head
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    counts = counts[known]
    place = np.zeros(known[-1] + 1, np.int32)
    place[known] = np.arange(len(known))
    table = zlib.compress(np.diff(known, prepend=0).astype("<u2").tobytes() + counts.astype("<u4").tobytes())
    rows, cum = np.zeros((lanes, block), np.int32), _cumulated(counts)
    rows.reshape(-1)[:n] = place.take(ids)
    words, n_words = zip(*(_encode(rows[a:b], cum) for a, b in _groups(lanes)))
    sums = [zlib.crc32(ids[k * block:(k + 1) * block].astype("<u4").tobytes()) for k in range(lanes)]
    index = np.stack([np.concatenate(n_words), sums], 1).astype("<u4")
    body = np.concatenate(words).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return head + struct.pack("<I", len(table)) + table + index.tobytes() + body.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment, as uint32; raises if a block's checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a token-id segment")
    version, n, block, lanes = struct.unpack_from("<IIII", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    if not n:
        return np.zeros(0, np.uint32)
    size, = struct.unpack_from("<I", data, 20)
    table = zlib.decompress(data[24:24 + size])
    known = np.cumsum(np.frombuffer(table, "<u2", len(table) // 6).astype(np.int64))
    cum = _cumulated(np.frombuffer(table, "<u4", -1, 2 * len(known)))
    at = 24 + size
    index = np.frombuffer(data, "<u4", 2 * lanes, at).reshape(lanes, 2)
    sizes = index[:, 0].astype(np.int64)
    body = np.zeros((int(sizes.sum()), 4), np.uint8)
    body[:, :3] = np.frombuffer(data, np.uint8, 3 * len(body), at + 8 * lanes).reshape(-1, 3)
    words, ends = body.view("<u4").reshape(-1), np.concatenate([[0], np.cumsum(sizes)])
    parts = [_decode(words[ends[a]:ends[b]], sizes[a:b], cum, block).reshape(-1) for a, b in _groups(lanes)]
    # a damaged code can lead past the last id; its block's checksum tells
    ids = known.take(np.concatenate(parts)[:n], mode="clip").astype("<u4")
    for k in range(lanes):
        if zlib.crc32(ids[k * block:(k + 1) * block].tobytes()) != index[k, 1]:
            raise ValueError(f"checksum of block {k} differs")
    return ids
