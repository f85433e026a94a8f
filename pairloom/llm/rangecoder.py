"""Adaptive context-mixing range coder for token ids below 65536, in array operations.

A block of ids is dealt to lanes, each a stretch of it with a range coder of its own; all lanes of
all blocks of one shape, which is that many lanes and steps, advance together. Every id is predicted by three orders: the id that last
followed the two ids before it, with how often in a row it was right; the counts of all ids that
followed the id before it; and the counts of all ids so far. Which order codes an id is a symbol of
its own, whose shares are learnt by how sure order 2 is and how often and how variedly order 1 has
seen its context; within orders 1 and 0 the counts are the shares. Ids that the block has not had
follow an escape as 16 plain bits. Order 2 and the shares learn every 64 steps, the counts after
steps that grow by a third or a half, from all lanes at once. The model starts anew with each
block, so that blocks decode independently.

Block format, little-endian: magic u32, ids u32, CRC-32 of the ids as u32 each u32, CRC-32 of the
rest u32, lanes u32, digits of each lane u16, then the digits, 24 bits each, lane by lane; zero
digits at a lane's end are left out. Where that is no shorter than 16 bits an id, lanes is 0 and the
ids follow, u16 each.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = 0x32524D43
#: Ids of a full block, of 256 lanes of 1024 steps.
BLOCK_IDS = 1 << 18
#: Contexts of order 2 are hashed to so many slots a block.
_SLOTS = 1 << 16
_BY_TWO, _BY_ONE = np.uint16(40503), np.uint16(25173)
#: An id's row of counts is that of the 2 ** 16 ids or, one beyond them, the escape.
_IDS = 1 << 16
_SHARES = 1 << 16
#: State of 48 bits, which float64 holds exactly; a digit of 24 bits leaves when the range falls below 2 ** 24.
_TOP, _DIGIT = float(1 << 48), float(1 << 24)
_HEAD = struct.Struct("<IIII")
#: Steps whose models are looked up in one go, and blocks that are coded in one go.
_AT_ONCE, _BLOCKS_AT_ONCE = 32, 64
#: Steps after which order 2 and the shares are learnt, and those after which counts are.
_LEARN_EVERY = 64
_COUNT_AT = (4, 16, 64, 192, 512)
#: Rows of shares: how sure order 2 is (8), how often (8) and how variedly (4) order 1 has seen the context.
_SURE, _OFTEN, _VARIED = 8, 8, 4
_EDGES = np.array([1, 2, 4, 8, 32, 128, 1024])
_ROWS = _SURE * _OFTEN * _VARIED
#: So that 16 bits further down it is where the rows of shares begin.
_SURE_BIT = 16 + (_OFTEN * _VARIED).bit_length() - 1


def _first_shares() -> np.ndarray:
    """Counts for orders 2, 1 and 0 to begin with, for each row."""
    sure, often, varied = np.meshgrid(np.arange(_SURE), np.arange(_OFTEN), np.arange(_VARIED), indexing="ij")
    two = np.where(sure > 0, sure / (sure + 3.0), 0.01)
    one = np.where(often > 0, (often + 4 * (_VARIED - varied)) / (often + 4 * (_VARIED - varied) + 8.0), 0.01)
    return (8 * np.stack([two, (1 - two) * one, (1 - two) * (1 - one)], -1) + 0.02).reshape(-1, 3)


def lanes_of(ids: int) -> int:
    """The lanes of a block of that many ids, so that short ones do not consist of lane ends."""
    return max(1, round(math.sqrt(ids) / 2))


def _shape(ids: int, lanes: int) -> tuple[int, int]:
    """(lanes, steps)"""
    return lanes, -(-ids // lanes)


class _Models:
    """Order 2, the shares and order 0 of several blocks of one shape; lane l belongs to block l // lanes."""

    def __init__(self, blocks: int, lanes: int):
        self.blocks, self.block = blocks, np.repeat(np.arange(blocks), lanes)
        self.slots, self.rows, self.shares, self.ids = (self.block * n for n in (_SLOTS, _IDS, _ROWS, _IDS + 1))
        self.last = np.zeros(blocks * _SLOTS, np.int32)  # the id that came last, from bit _SURE_BIT on how sure it is
        self.share = np.tile(_first_shares(), (blocks, 1))
        self.count = np.zeros((blocks, _IDS + 1), np.int64)
        self.by_id = np.zeros(self.count.size, np.int64)
        self._share_tables()
        self._id_tables()

    def _share_tables(self) -> None:
        part = self.share / self.share.sum(axis=1, keepdims=True)
        first = np.clip(np.floor(part[:, 0] * _SHARES), 1, _SHARES - 2)
        self.two, self.one = first, np.clip(np.floor((part[:, 0] + part[:, 1]) * _SHARES), first + 1, _SHARES - 1)
        edges = np.stack([np.zeros(len(first)), self.two, self.one, np.full(len(first), float(_SHARES))], axis=1)
        self.upto, self.width = edges[:, :3].ravel(), np.diff(edges, axis=1).ravel()

    def _id_tables(self) -> None:
        """Entry of an id: itself, above 17 bits where it starts among the block's ids, above 20 more its count."""
        self.count[:, _IDS] = 1
        at = (self.count.ravel() != 0).nonzero()[0]
        self.seen, block = self.count.ravel()[at], at // (_IDS + 1)
        # An escape weighs as much as the ids that came once; itself it is the last of its block.
        escape = np.searchsorted(block, np.arange(self.blocks), "right") - 1
        self.seen[escape] = np.maximum(1, np.bincount(block[self.seen == 1], minlength=self.blocks) - 1)
        self.total = np.add.reduceat(self.seen, np.concatenate([[0], escape[:-1] + 1]))
        begin = np.cumsum(self.total) - self.total
        start = np.cumsum(self.seen) - self.seen - begin[block]
        self.by_id[at] = self.entry = (at - block * (_IDS + 1)) | start << 17 | self.seen << 37

    def context(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """(slot of order 2, what it holds, row of shares) of ids before, u16 by lane, and the kinds of their rows of order 1."""
        slot = self.slots + (two * _BY_TWO + one * _BY_ONE)  # which wraps around at _SLOTS
        held = self.last.take(slot)
        return slot, held, self.shares + (held >> 16) + kind

    def learn(self, ids: np.ndarray, slot: np.ndarray, held: np.ndarray, which: np.ndarray, part: np.ndarray) -> None:
        """Order 2 and the shares, from arrays of steps x lanes; which: three times the row of shares and the order that coded the id."""
        self.share += np.bincount(which.ravel(), minlength=self.share.size).reshape(self.share.shape)
        # Of several in one slot, the one written last holds.
        new = np.minimum(held, np.int32((_SURE - 2 << _SURE_BIT) + _IDS - 1))
        new >>= _SURE_BIT
        new *= part == 0
        new += 1
        new <<= _SURE_BIT
        new += ids
        self.last[slot.ravel()] = new.ravel()
        self._share_tables()

    def learn_ids(self, ids: np.ndarray) -> None:
        self.count += np.bincount((self.ids + ids).ravel(), minlength=self.count.size).reshape(self.count.shape)
        self._id_tables()


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal ones begin."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new.nonzero()[0]


def _kinds(size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """How often and how variedly rows of order 1 were seen."""
    return np.searchsorted(_EDGES, size, "right") * _VARIED + np.minimum(kinds * _VARIED // np.maximum(size, 1), _VARIED - 1)


_SIZE_AT, _LOW_AT, _KIND = 16, 35, (1 << 16) - 1


class _Followers:
    """Order 1 for a decoder: the ids that followed each id, in rows beside those of order 0."""

    def __init__(self, model: _Models):
        self.model = model
        # Block, id before and id of all that was learnt, sorted.
        self.pairs = np.zeros(0, np.int64)
        # Rows of entries: an id's followers, then a block's ids, then one that costs nothing. Of each the block's first row of
        # shares and its kind, from bit _SIZE_AT on its size and from bit _LOW_AT on where it begins.
        self.rows = np.repeat(np.arange(model.blocks) * _ROWS, _IDS)
        self._tables()

    def _tables(self) -> None:
        """An entry is there as often as it counts, so that a place in a row leads to it."""
        k, model = self.pairs, self.model
        run = _starts(k)
        times, keys = np.diff(run, append=len(k)), k[run]
        head = _starts(keys >> 16)
        rows, low = keys[head] >> 16, run[head]
        size, kinds = np.diff(low, append=len(k)), np.diff(head, append=len(run))
        self.rows[rows] = (rows >> 16) * _ROWS + _kinds(size, kinds) | size << _SIZE_AT | low << _LOW_AT
        entry = (keys & (_IDS - 1)) | (run - np.repeat(low, kinds)) << 17 | times << 37
        self.zero = (model.total << _SIZE_AT | (len(k) + np.cumsum(model.total) - model.total) << _LOW_AT)[model.block]
        self.entries = np.repeat(np.concatenate([entry, model.entry, [1 << 37]]), np.concatenate([times, model.seen, [1]]))
        self.none = 1 << _SIZE_AT | (len(self.entries) - 1) << _LOW_AT

    def learn(self, ids: np.ndarray, one: np.ndarray) -> None:
        lanes = ids.shape[1] // self.model.blocks
        pairs = [np.sort((one[:, a : a + lanes].astype(np.uint32) << 16) + ids[:, a : a + lanes], axis=None) for a in range(0, ids.shape[1], lanes)]
        self.pairs = np.concatenate([self.pairs, ((np.arange(len(pairs)) << 32)[:, None] + np.stack(pairs)).ravel()])
        self.pairs.sort(kind="stable")  # merges the two
        self._tables()


def _followers(model: _Models, ids: np.ndarray) -> np.ndarray:
    """What _Followers will have of each id but the first two rows: its row's kind, above 5 bits the row's size, above 19 more where it
    starts in the row and above 18 more its count, 0 if it is not there."""
    lanes = ids.shape[1] // model.blocks
    out = np.empty((len(ids) - 2, ids.shape[1]), np.int64)
    for a in range(0, ids.shape[1], lanes):  # stays within the cache
        out[:, a : a + lanes] = _followers_of_block(ids[:, a : a + lanes])
    return out


def _followers_of_block(ids: np.ndarray) -> np.ndarray:
    """_followers() of one block.

    All ids are sorted once. From the last stretch to the first, what its model knows is counted along that order.
    """
    steps, lanes = len(ids) - 2, ids.shape[1]
    bits = (steps * lanes).bit_length()
    asked = ids[1:-1].astype(np.int64)
    asked <<= 16
    asked += ids[2:]
    asked <<= bits
    asked = asked.ravel()
    asked |= np.arange(steps * lanes)
    asked.sort()
    out = np.zeros(steps * lanes, np.int64)
    place, key = (asked & ((1 << bits) - 1)).astype(np.int32), asked >> bits
    for first in reversed([c for c in _COUNT_AT if c < steps]):
        known = place < first * lanes
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        group = new.nonzero()[0]
        head = _starts(key[group] >> 16)
        upto = np.zeros(len(key) + 1, np.int32)
        np.cumsum(known, out=upto[1:])
        low = upto[group].astype(np.int64)
        times, row_low = np.diff(low, append=upto[-1:]), low[head]
        row_size, groups = np.diff(row_low, append=upto[-1:]), np.diff(head, append=len(group))
        row = (_kinds(row_size, np.add.reduceat(times > 0, head, dtype=np.int64)) | row_size << 5) - (row_low << 24)
        of_group = np.repeat(row, groups) + (low << 24) + (times << 42)
        asking = (~known).nonzero()[0]
        out[place.take(asking)] = of_group.take(np.cumsum(new, dtype=np.int32).take(asking) - 1)
        known = known.nonzero()[0]
        place, key = place.take(known), key.take(known)
    return out.reshape(steps, lanes)


def _stretches(steps: int) -> list[tuple[int, int, bool]]:
    """(first, end, whether counts are learnt at the end) of the steps between which nothing is learnt."""
    cuts = sorted({s for s in (*_COUNT_AT, *range(_LEARN_EVERY, steps, _LEARN_EVERY)) if s < steps} | {steps})
    return [(a, b, b in _COUNT_AT) for a, b in zip([0, *cuts], cuts, strict=False)]


class _Encoder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, _TOP)
        self.lanes, self.digits = [], []

    def shift(self, short: np.ndarray) -> None:
        """A digit leaves these lanes, whose range is short."""
        if len(short):
            low = self.low[short]
            digit = np.floor(low / _DIGIT)
            # Its carry, the 25th bit, is settled at the end.
            self.lanes.append(short)
            self.digits.append(digit)
            self.low[short] = (low - digit * _DIGIT) * _DIGIT
            self.range[short] *= _DIGIT

    def put(self, start: np.ndarray, size: np.ndarray, total) -> None:
        unit = self.range / total
        np.floor(unit, out=unit)
        self.low += unit * start
        np.multiply(unit, size, out=self.range)
        self.shift((self.range < _DIGIT).nonzero()[0])

    def put_id(self, lanes: np.ndarray, ids: np.ndarray) -> None:
        """Plain ids of some lanes."""
        unit = np.floor(self.range[lanes] / _IDS)
        self.low[lanes] += unit * ids
        self.range[lanes] = unit
        self.shift(lanes[unit < _DIGIT])

    def end(self) -> list[np.ndarray]:
        """The digits of each lane."""
        # The range holds a number whose further digits are all zero.
        every = np.arange(len(self.low))
        lane = np.concatenate([*self.lanes, every])
        digits = np.concatenate([*self.digits, np.ceil(self.low / _DIGIT)]).astype(np.int32)
        digits = digits[np.argsort(lane.astype(np.uint16), kind="stable")]
        while (carry := digits >> 24).any():  # never out of a lane's first digit
            digits &= (1 << 24) - 1
            digits[:-1] += carry[1:]
        size = np.bincount(lane)
        begin = np.cumsum(size) - size
        used = np.maximum.reduceat(np.where(digits != 0, np.arange(1, len(digits) + 1), 0), begin)
        return [digits[a:z] for a, z in zip(begin.tolist(), np.maximum(used, begin).tolist(), strict=True)]


def _encode_steps(model: _Models, coder: _Encoder, ids: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes all rows of ids but the first two, which are the ids before; returns what the model learns from."""
    steps, lanes = len(ids) - 2, ids.shape[1]
    slot, held, share = model.context(ids[1:-1], ids[:-2], follower & 31)
    x, count = ids[2:], follower >> 42
    part = np.where(count > 0, np.int8(1), np.int8(2))
    part[(held & 0xFFFF) == x] = 0
    first = part == 1
    follower = np.where(first, follower, 1 << 42 | 1 << 5)
    start, count, total = ((follower >> 24 & 0x3FFFF).astype(float), (follower >> 42).astype(float), (follower >> 5 & 0x7FFFF).astype(float))
    zeroth = (part == 2).ravel().nonzero()[0]
    lane = zeroth % lanes
    by_id = model.by_id[model.ids[lane] + x.ravel()[zeroth]]
    new = by_id == 0
    by_id[new] = model.by_id[model.ids[lane[new]] + _IDS]
    start.reshape(-1)[zeroth], count.reshape(-1)[zeroth], total.reshape(-1)[zeroth] = (by_id >> 17) & 0xFFFFF, by_id >> 37, model.total[model.block[lane]]
    orders = share * 3
    orders += part
    upto, width = model.upto.take(orders), model.width.take(orders)
    new = zeroth[new]
    new = np.split(new, np.searchsorted(new, np.arange(1, steps) * lanes))
    for k in range(steps):
        coder.put(upto[k], width[k], _SHARES)
        coder.put(start[k], count[k], total[k])
        if len(new[k]):
            which = new[k] - k * lanes
            coder.put_id(which, x[k, which])
    return slot, held, orders, part


def _encode_shape(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of one shape."""
    n, (lanes, steps) = len(blocks), _shape(len(blocks[0]), lanes_of(len(blocks[0])))
    # Two rows of zeros come first, so that the ids before are there too. Lanes are filled up with
    # id 0; the count in the head cuts that off.
    ids = np.zeros((steps + 2, n * lanes), np.uint16)
    for k, b in enumerate(blocks):
        ids[2:, k * lanes : (k + 1) * lanes] = np.concatenate([b, np.zeros(steps * lanes - len(b), b.dtype)]).reshape(lanes, steps).T
    slots, orders = np.zeros((2, _LEARN_EVERY, n * lanes), np.int64)
    helds = np.zeros((_LEARN_EVERY, n * lanes), np.int32)
    parts = np.zeros((_LEARN_EVERY, n * lanes), np.int8)
    model, coder, counted = _Models(n, lanes), _Encoder(n * lanes), 0
    followers = _followers(model, ids)
    for a, z, learn in _stretches(steps):
        for at in range(a, z, _AT_ONCE):  # stays within the cache
            end = min(z, at + _AT_ONCE)
            to = slice(at - a, end - a)
            slots[to], helds[to], orders[to], parts[to] = _encode_steps(model, coder, ids[at : end + 2], followers[at:end])
        if z < steps:
            model.learn(ids[a + 2 : z + 2], *(v[: z - a] for v in (slots, helds, orders, parts)))
            if learn:
                model.learn_ids(ids[counted + 2 : z + 2])
                counted = z
    streams, out = coder.end(), []
    for k, b in enumerate(blocks):
        mine = streams[k * lanes : (k + 1) * lanes]
        digits = np.concatenate(mine).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        body = struct.pack(f"<I{lanes}H", lanes, *map(len, mine)) + digits
        if len(body) > 4 + 2 * len(b):
            body = bytes(4) + np.asarray(b, "<u2").tobytes()
        out.append(_HEAD.pack(MAGIC, len(b), zlib.crc32(np.asarray(b, "<u4").tobytes()), zlib.crc32(body)) + body)
    return out


def _together(shapes: list[tuple[int, int]]) -> list[list[int]]:
    """The numbers of blocks of one shape, _BLOCKS_AT_ONCE at most together."""
    by_shape: dict[tuple[int, int], list[int]] = {}
    for k, shape in enumerate(shapes):
        by_shape.setdefault(shape, []).append(k)
    return [w[a : a + _BLOCKS_AT_ONCE] for w in by_shape.values() for a in range(0, len(w), _BLOCKS_AT_ONCE)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One record for each array of 1 to BLOCK_IDS ids; those of as many lanes and steps are coded together."""
    out: dict[int, bytes] = {}
    for which in _together([_shape(len(b), lanes_of(len(b))) for b in blocks]):
        out.update(zip(which, _encode_shape([blocks[k] for k in which]), strict=True))
    return [out[k] for k in range(len(blocks))]


class _Decoder:
    def __init__(self, streams: list[np.ndarray]):
        # A column for each lane; the zero digits after it are read as often as it takes, the last row's ever after.
        lanes, size = len(streams), np.array([len(x) for x in streams])
        data = np.zeros((int(size.max()) + 3, lanes))
        column = np.repeat(np.arange(lanes), size)
        data[np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size), column] = np.concatenate(streams)
        self.data, self.lanes, self.at = data.ravel(), lanes, np.arange(lanes)
        self.value = self.data[self.at] * _DIGIT + self.data[self.at + lanes]
        self.at, self.range = self.at + 2 * lanes, np.full(lanes, _TOP)

    def shift(self) -> None:
        short = (self.range < _DIGIT).nonzero()[0]
        if len(short):
            at = self.at[short]
            self.value[short] = self.value[short] * _DIGIT + self.data.take(at, mode="clip")
            self.range[short] *= _DIGIT
            self.at[short] = at + self.lanes

    def take_id(self, lanes: np.ndarray) -> np.ndarray:
        """Plain ids of some lanes."""
        size, value = self.range[lanes], self.value[lanes]
        unit = np.floor(size * (1 / _IDS))
        ids = np.floor(value / unit)
        value -= unit * ids
        short = (unit < _DIGIT).nonzero()[0]
        at = self.at[lanes[short]]
        value[short] = value[short] * _DIGIT + self.data.take(at, mode="clip")
        unit[short] *= _DIGIT
        self.value[lanes], self.range[lanes] = value, unit
        self.at[lanes[short]] = at + self.lanes
        return ids


def _decode_shape(records: list[bytes], sizes: list[int], lanes: int, steps: int) -> list[np.ndarray]:
    """Blocks of one shape and so many ids, none of which is plain."""
    n, streams = len(records), []
    for r in records:
        ends = np.cumsum(np.frombuffer(r, "<u2", lanes, _HEAD.size + 4), dtype=np.int64)
        raw = np.frombuffer(r, np.uint8, 3 * int(ends[-1]), _HEAD.size + 4 + 2 * lanes).reshape(-1, 3)
        streams += np.split(raw @ np.array([1, 1 << 8, 1 << 16]), ends[:-1])
    model, coder, counted = _Models(n, lanes), _Decoder(streams), 0
    rows = _Followers(model)
    ids = np.zeros((steps + 2, n * lanes), np.uint16)  # as in _encode_shape()
    slots, orders = np.zeros((2, _LEARN_EVERY, n * lanes), np.int64)
    helds = np.zeros((_LEARN_EVERY, n * lanes), np.int32)
    parts = np.zeros((_LEARN_EVERY, n * lanes), np.int8)
    for a, z, learn in _stretches(steps):
        two, one, upto, width, zero, none, entries = model.two, model.one, model.upto, model.width, rows.zero, rows.none, rows.entries
        for k, slot, held, order, part in zip(range(a, z), slots, helds, orders, parts, strict=False):
            row = rows.rows.take(model.rows + ids[k + 1])
            np.add(model.slots, ids[k] * _BY_TWO + ids[k + 1] * _BY_ONE, out=slot)
            model.last.take(slot, out=held, mode="clip")
            share = (row & _KIND) + (held >> 16)
            unit = np.floor(coder.range * (1 / _SHARES))
            not_two, not_one = coder.value >= unit * two.take(share), coder.value >= unit * one.take(share)
            np.multiply(share, 3, out=order)
            order += np.add(not_two.view(np.int8), not_one.view(np.int8), out=part)
            coder.value -= unit * upto.take(order)
            np.multiply(unit, width.take(order), out=coder.range)
            coder.shift()
            at = np.where(not_two, row, none)
            np.copyto(at, zero, where=not_one)
            unit = np.floor(coder.range / (at >> _SIZE_AT & 0x7FFFF))
            at >>= _LOW_AT
            at += (coder.value / unit).astype(np.int64)
            entry = entries.take(at, mode="clip")
            coder.value -= unit * (entry >> 17 & 0xFFFFF)
            np.multiply(unit, entry >> 37, out=coder.range)
            coder.shift()
            x = ids[k + 2]
            x[:] = held
            np.copyto(x, entry, where=not_two, casting="unsafe")
            if len(first := not_one.nonzero()[0]):
                new = first[entry.take(first) & 0x1FFFF == _IDS]
                if len(new):
                    x[new] = coder.take_id(new)
        if z < steps:
            model.learn(ids[a + 2 : z + 2], *(v[: z - a] for v in (slots, helds, orders, parts)))
            if learn:
                model.learn_ids(ids[counted + 2 : z + 2])
                rows.learn(ids[counted + 2 : z + 2], ids[counted + 1 : z + 1])
                counted = z
    ids = ids[2:].T.reshape(n, lanes * steps).astype(np.uint32)
    return [b[:size] for b, size in zip(ids, sizes, strict=True)]


def decode_blocks(records: list[bytes]) -> list[np.ndarray]:
    """The ids of each record; raises ValueError where a checksum does not hold."""
    sizes = []
    for k, r in enumerate(records):
        magic, size, _, crc = _HEAD.unpack_from(r)
        if magic != MAGIC or zlib.crc32(memoryview(r)[_HEAD.size :]) != crc:
            raise ValueError(f"block {k}: damaged")
        sizes.append(size)
    coded = [k for k, r in enumerate(records) if struct.unpack_from("<I", r, _HEAD.size)[0]]
    done = {k: np.frombuffer(r, "<u2", sizes[k], _HEAD.size + 4).astype(np.uint32) for k, r in enumerate(records) if k not in coded}
    shapes = [_shape(sizes[k], *struct.unpack_from("<I", records[k], _HEAD.size)) for k in coded]
    for which in _together(shapes):
        shape, which = shapes[which[0]], [coded[k] for k in which]
        done.update(zip(which, _decode_shape([records[k] for k in which], [sizes[k] for k in which], *shape), strict=True))
    for k, ids in done.items():
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != _HEAD.unpack_from(records[k])[2]:
            raise ValueError(f"block {k}: ids do not match their checksum")
    return [done[k] for k in range(len(records))]
