"""An adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

Each block of BLOCK ids has models of its own, reset at its start. Ids are named by the order in which they
first appear in the block (slots). Three models predict the next slot: order 0 counts every slot, with
sums by a tree; order 1 and order 2 remember which slot last followed the previous one and the previous two, and how often that
held. The chance that the order-2 guess is right is mixed from the predictions of the three orders (order
0's is the guess's share of all ids so far) in the logistic domain, with weights that learn from every
id. If it is wrong, the order-1 guess follows, then order 0's frequencies of all slots, and last
an id that is new to the block: adaptive frequencies of its leading bits, then the remaining bits. All
arithmetic is on integers, so decoding repeats it exactly. Ids may have up to 32 bits.

The range coder keeps 32 bits and puts out 16-bit words; carries are settled when a block ends.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

BLOCK = 2048
WIDTHS = (8, 16, 16)
"""Children of the nodes of order 0's tree by level: one leaf for each of BLOCK slots."""
CLASSES = 8 + 29 * 4
WORD_BITS = 16
HEAD = struct.Struct("<4sIII")
MAGIC = b"SWT2"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """squash (of -2047..2047), stretch (of 0..4095), what class frequencies move to, and where they begin (classes of ids of up to 16 bits weigh more)."""
    squash = np.clip(np.floor(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256)) + 0.5).astype(np.int64), 1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4094) - 2047
    i = np.arange(CLASSES + 1)
    target = np.where(i[None, :] <= np.arange(CLASSES)[:, None], i[None, :], 4096 - CLASSES + i[None, :])
    small = 8 + 13 * 4
    begin = i + np.minimum(i, small) * (4096 - CLASSES) // small
    return squash.astype(np.int32), stretch.astype(np.int32), target.astype(np.int32), begin.astype(np.int32)


@cache
def _smaller(width: int) -> np.ndarray:
    """Row d: 1 for each child before d."""
    return np.tril(np.ones((width, width), dtype=np.uint16), -1)


class Counts:
    """Order 0: how often each slot of each lane came, and the sums of these by a tree of three levels."""

    def __init__(self, lanes: int):
        self.at, self.levels, nodes = np.arange(lanes) * BLOCK, [], lanes
        for width in WIDTHS:
            self.levels.append(np.zeros((nodes, width), dtype=np.uint16))
            nodes *= width
        self.counts = self.levels[-1].ravel()

    def before(self, lanes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The counts of all smaller slots."""
        leaf, total = lanes * BLOCK + slots, 0
        for level, shift in zip(self.levels, (8, 4, 0)):
            node, width = leaf >> shift, level.shape[1]
            total = total + np.einsum("ij,ij->i", level.take(node // width, axis=0), _smaller(width).take(node % width, axis=0))
        return total.astype(np.int64)

    def find(self, lanes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot whose share holds place, and the counts of all smaller slots."""
        node, left, r = lanes, place.astype(np.uint16), np.arange(len(lanes))
        for level in self.levels:
            upto = np.cumsum(level.take(node, axis=0), axis=1, dtype=np.uint16)
            child = (upto <= left[:, None]).sum(axis=1)
            left = left - np.where(child > 0, upto[r, child - 1], 0).astype(np.uint16)
            node = node * level.shape[1] + child
        return node - lanes * BLOCK, place - left

    def add(self, slots: np.ndarray) -> None:
        """One more of slots, one for each lane."""
        leaf = self.at + slots
        for level, shift in zip(self.levels, (8, 4, 0)):
            level.ravel()[leaf >> shift] += 1


class Models:
    """Predictions for the next slot of each lane."""

    def __init__(self, lanes: int):
        _, _, _, begin = _tables()
        self.at = np.arange(lanes) * BLOCK
        self.four = np.arange(lanes) * 8
        self.steps = 0
        self.previous, self.last, self.known = (np.zeros(lanes, dtype=np.int64) for _ in range(3))
        self.order0 = Counts(lanes)
        self.follow = [np.zeros(lanes * BLOCK, dtype=np.uint16) for _ in range(2)]
        self.trust = [np.zeros(lanes * BLOCK, dtype=np.uint8) for _ in range(2)]
        self.hit = [np.full(lanes * 8, 1 << 14, dtype=np.int32) for _ in range(3)]
        self.novel = np.full(lanes, 1 << 15, dtype=np.int32)
        self.weights = [np.full(lanes, w, dtype=np.int32) for w in (28000, 20000, 14000)]
        self.classes = np.tile(begin, (lanes, 1))

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The two guesses, and the frequencies (of 4096) of the first, of the second and of an id new to the block."""
        squash, stretch = _tables()[:2]
        self.places = [self.at + ((self.previous * 40503 + self.last * 60493) >> 4) % BLOCK, self.at + self.last]
        guess, second_guess = (f[p] for f, p in zip(self.follow, self.places))
        self.seen = [t[p] for t, p in zip(self.trust, self.places)]
        self.agree = guess == second_guess
        self.context = [self.four + k * 2 + self.agree for k in (*self.seen, self.seen[1])]
        p = [hit[i] >> 4 for hit, i in zip(self.hit, self.context)]
        share = np.clip(self.order0.counts[self.at + guess].astype(np.int32) * 4096 // max(self.steps, 1), 1, 4095)
        self.inputs = [stretch[p[0]], stretch[p[1]], stretch[share]]
        dot = sum(w * x for w, x in zip(self.weights, self.inputs)) >> 16
        self.mixed = squash[np.clip(dot, -2047, 2047) + 2047]
        first = np.minimum(self.mixed, 4000)
        second = np.clip(((4096 - first) * p[2]) >> 12, 1, 4094 - first)
        second[self.agree] = 0
        left = 4096 - first - second
        return guess, second_guess, first, second, np.clip((left * (self.novel >> 4)) >> 12, 1, left - 1)

    def learn(self, slots: np.ndarray, guesses: tuple[np.ndarray, np.ndarray], one: np.ndarray, two: np.ndarray, new: np.ndarray) -> None:
        error = (one.astype(np.int32) << 12) - self.mixed
        for w, x in zip(self.weights, self.inputs):
            w += (x * error) >> 10
        goal = one.astype(np.int32) * 65535
        for hit, at in zip(self.hit[:2], self.context):
            now = hit[at]
            hit[at] = now + ((goal - now) >> 4)
        missed = np.flatnonzero(~(one | self.agree))
        now = self.hit[2][self.context[2][missed]]
        self.hit[2][self.context[2][missed]] = now + ((two[missed].astype(np.int32) * 65535 - now) >> 4)
        missed = np.flatnonzero(~(one | two))
        now = self.novel[missed]
        self.novel[missed] = now + ((new[missed].astype(np.int32) * 65535 - now) >> 5)
        for k in (0, 1):
            seen, yes = self.seen[k], (slots == guesses[k]) & ~new
            firm = seen > 1
            self.follow[k][self.places[k]] = np.where(yes | firm, guesses[k], slots)
            self.trust[k][self.places[k]] = np.where(yes, np.minimum(seen + 1, 3), np.where(firm, seen - 1, 1))
        self.order0.add(slots)
        self.known += new
        self.steps += 1
        self.previous, self.last = self.last, slots

    def learn_class(self, lanes: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
        rows += (_tables()[2][classes] - rows) >> 5
        self.classes[lanes] = rows


def _class_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An id's class (its bit length and the two bits after the first; ids under 8 alone) and the number of bits that are left."""
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1].astype(np.int64) - 3, 0)
    return np.where(bits > 0, 4 + bits * 4 + (ids >> bits & 3), ids), bits


def _first_of(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A class's smallest id, and its number of bits left."""
    bits = np.maximum((classes - 4) >> 2, 0)
    return np.where(classes < 8, classes, (4 | classes & 3) << bits), np.where(classes < 8, 0, bits)


def slots_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ids, each one's number in order of first appearance, and whether it appears for the first time."""
    lanes, steps = ids.shape
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, axis=1)
    opens = np.ones((lanes, steps), dtype=bool)
    opens[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    first = np.take_along_axis(order, np.maximum.accumulate(np.where(opens, np.arange(steps), 0), axis=1), axis=1)
    new = np.zeros((lanes, steps), dtype=bool)
    np.put_along_axis(new, order, opens, axis=1)
    number = np.cumsum(new, axis=1) - 1
    slots = np.empty((lanes, steps), dtype=np.int64)
    np.put_along_axis(slots, order, np.take_along_axis(number, first, axis=1), axis=1)
    return slots, new


def encode(ids: np.ndarray) -> list[bytes]:
    """Coded words of each row of ids (lanes x steps, unsigned)."""
    lanes, steps = ids.shape
    models = Models(lanes)
    low, span, at = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << 32, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    words = np.zeros((steps * 4 + 4, lanes), dtype=np.uint32)
    flat = words.ravel()

    def put(which: np.ndarray | None) -> None:
        small = np.flatnonzero(span < 1 << 16) if which is None else which[span[which] < 1 << 16]
        value = low[small]
        flat[at[small] * lanes + small] = value >> 16
        low[small] = (value & 0xFFFF) << 16
        span[small] <<= 16
        at[small] += 1

    slots, fresh = slots_of(ids)
    columns, slots, fresh = (np.ascontiguousarray(x.T) for x in (ids, slots, fresh))
    for t in range(steps):
        slot, new = slots[t], fresh[t]
        guess, second_guess, first, second, novel = models.predict()
        one = (slot == guess) & ~new
        two = (slot == second_guess) & ~new & ~one
        unit = span >> 12
        low += unit * np.where(one, 0, np.where(two, first, np.where(new, 4096 - novel, first + second)))
        span[:] = unit * np.where(one, first, np.where(two, second, np.where(new, novel, 4096 - first - second - novel)))
        put(None)
        rest = np.flatnonzero(~(one | two | new))
        if len(rest):
            unit = span[rest] // t
            low[rest] += unit * models.order0.before(rest, slot[rest])
            span[rest] = unit * models.order0.counts[models.at[rest] + slot[rest]]
            put(rest)
        rest = np.flatnonzero(new)
        if len(rest):
            value = columns[t][rest].astype(np.int64)
            kind, bits = _class_of(value)
            rows, r = models.classes[rest], np.arange(len(rest))
            begin = rows[r, kind]
            unit = span[rest] >> 12
            low[rest] += unit * begin
            span[rest] = unit * (rows[r, kind + 1] - begin)
            put(rest)
            models.learn_class(rest, rows, kind)
            for n, skip in ((np.maximum(bits - 16, 0), 16), (np.minimum(bits, 16), 0)):
                if n.any():
                    unit = span[rest] >> n
                    low[rest] += unit * (value >> skip & ((1 << n) - 1))
                    span[rest] = unit
                    put(rest)
        models.learn(slot, (guess, second_guess), one, two, new)
    for shift in (16, 0):
        flat[at * lanes + np.arange(lanes)] = (low >> 16) if shift else (low & 0xFFFF)
        at += 1
    digits = words[: at.max()]
    while (digits >> WORD_BITS).any():
        carry = digits >> WORD_BITS
        digits &= 0xFFFF
        digits[:-1] += carry[1:]
    rows = np.ascontiguousarray(digits.T.astype("<u2"))
    return [row[:n].tobytes() for row, n in zip(rows, at)]


def decode(coded: list[bytes], steps: int = BLOCK) -> np.ndarray:
    """The ids (lanes x steps) that were coded."""
    lanes = len(coded)
    sizes = np.array([len(c) // 2 for c in coded], dtype=np.int64)
    start = np.cumsum(sizes + 2) - sizes - 2
    words = np.zeros(int((sizes + 2).sum()), dtype=np.int64)
    for c, s in zip(coded, start):
        words[s : s + len(c) // 2] = np.frombuffer(c, dtype="<u2")
    models = Models(lanes)
    names = np.zeros(lanes * BLOCK, dtype=np.uint32)
    code, span, at = words[start] << 16 | words[start + 1], np.full(lanes, 1 << 32, dtype=np.int64), start + 2
    out = np.zeros((steps, lanes), dtype=np.uint32)

    def take(which: np.ndarray | None) -> None:
        small = np.flatnonzero(span < 1 << 16) if which is None else which[span[which] < 1 << 16]
        code[small] = code[small] << 16 | words[at[small]]
        span[small] <<= 16
        at[small] += 1

    for t in range(steps):
        guess, second_guess, first, second, novel = models.predict()
        unit = span >> 12
        place = np.minimum(code // unit, 4095)
        both = first + second
        one, new = place < first, place >= 4096 - novel
        two = (place < both) & ~one
        code -= unit * np.where(one, 0, np.where(two, first, np.where(new, 4096 - novel, both)))
        span[:] = unit * np.where(one, first, np.where(two, second, np.where(new, novel, 4096 - both - novel)))
        take(None)
        slot = np.where(one, guess, second_guess).astype(np.int64)
        rest = np.flatnonzero(~(one | two | new))
        if len(rest):
            unit = span[rest] // t
            found, begin = models.order0.find(rest, np.minimum(code[rest] // unit, t - 1))
            code[rest] -= unit * begin
            span[rest] = unit * models.order0.counts[models.at[rest] + found]
            take(rest)
            slot[rest] = found
        rest = np.flatnonzero(new)
        if len(rest):
            rows, r = models.classes[rest], np.arange(len(rest))
            unit = span[rest] >> 12
            place = np.minimum(code[rest] // unit, 4095)
            kind = (rows <= place[:, None]).sum(axis=1) - 1
            begin = rows[r, kind]
            code[rest] -= unit * begin
            span[rest] = unit * (rows[r, kind + 1] - begin)
            take(rest)
            models.learn_class(rest, rows, kind)
            value, bits = _first_of(kind)
            for n, skip in ((np.maximum(bits - 16, 0), 16), (np.minimum(bits, 16), 0)):
                if n.any():
                    unit = span[rest] >> n
                    piece = np.minimum(code[rest] // unit, (1 << n) - 1)
                    code[rest] -= unit * piece
                    span[rest] = unit
                    take(rest)
                    value = value | piece << skip
            slot[rest] = models.known[rest]
            names[models.at[rest] + slot[rest]] = value
        out[t] = names[models.at + slot]
        models.learn(slot, (guess, second_guess), one, two, new)
    return out.T


def pack(ids: np.ndarray, coded: bytes) -> bytes:
    """A block as it is stored: magic, number of ids, checksum of the ids, checksum of all that is stored beside it, the coded words."""
    body = HEAD.pack(MAGIC, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), 0) + coded
    return body[: HEAD.size - 4] + struct.pack("<I", zlib.crc32(body)) + coded


def _opened(block: bytes) -> tuple[int, int, bytes]:
    """Number of ids, their checksum and the coded words of a stored block that is whole."""
    if len(block) < HEAD.size:
        raise ValueError("a block of token ids is cut short")
    magic, n, check, stored = HEAD.unpack_from(block)
    if magic != MAGIC or n > BLOCK:
        raise ValueError("not a block of token ids")
    if zlib.crc32(block[: HEAD.size - 4] + bytes(4) + block[HEAD.size :]) != stored:
        raise ValueError("a block's checksum doesn't match its bytes")
    return n, check, block[HEAD.size :]


def unpack(blocks: list[bytes], lanes: int = 2048) -> list[np.ndarray]:
    """The ids of stored blocks. The stored bytes are checked before they are decoded, the ids after; what doesn't match raises ValueError."""
    found = []
    for k in range(0, len(blocks), lanes):
        opened = [_opened(b) for b in blocks[k : k + lanes]]
        for (n, check, _), ids in zip(opened, decode([coded for _, _, coded in opened])):
            ids = np.ascontiguousarray(ids[:n])
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError("a block's checksum doesn't match its ids")
            found.append(ids)
    return found


def coded_blocks(ids: np.ndarray, lanes: int = 2048) -> list[bytes]:
    """Stored blocks of BLOCK ids each, the last one shorter."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, dtype=ids.dtype)
    padded[: len(ids)] = ids
    grid, out = padded.reshape(n, BLOCK), []
    for k in range(0, n, lanes):
        for i, coded in enumerate(encode(grid[k : k + lanes])):
            out.append(pack(ids[(k + i) * BLOCK : (k + i + 1) * BLOCK], coded))
    return out
