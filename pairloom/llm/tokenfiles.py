"""Token ids of documents in compressed binary files, and back.

write_token_files() tokenizes every text, appends an end id and writes files in ascending doc_id
order; read_token_files() gives the ids of each document again. A file holds whole documents:

    magic u32, version u32, documents u64, blocks u32, CRC-32 of the following index u32,
    index: doc_id i64 and ids u64 for each document, null flags u8 each, bytes of each block u32,
    then the block records of the range coder, one after the other.

Little-endian throughout. Documents follow one another across a file's blocks. File names sort in
the order of the ids. Files are written under another name and renamed, and a task that is run
again writes the same, so a lost executor leaves nothing half done.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import checked_broadcast, giving_back, materialise, shared_dir, store_bytes, table
from pairloom.llm.rangecoder import BLOCK_IDS, decode_blocks, encode_blocks

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Blocks of a file but a task's last one, which holds half as many to one and a half times as many, where they are full.
#: About so many are coded together.
FILE_BLOCKS = 10
#: Characters of texts that are tokenized at once.
_CHUNK_CHARS = 2_000_000
_MAGIC, _VERSION = 0x4B544C50, 2
_HEAD = struct.Struct("<IIQII")
#: A word of Latin letters, with a space before it or not, which the pre-tokenizer takes as one part.
_PLAIN = "^ ?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
#: The bytes of such words.
_PLAIN_BYTES = b"".join(bytes(range(a, z + 1)) for a, z in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC9)))
#: Such words that the model takes at once.
_WORDS_AT_ONCE = 64
#: Pieces that a worker remembers, and ids of pieces; then it forgets those that were rare.
_REMEMBERED, _REMEMBERED_IDS = 1_200_000, 1 << 26
#: By path, so that a worker's tasks share what it remembers.
_TOKENIZERS: dict[str, PieceTokenizer] = {}


def _classes() -> bytes:
    """For each byte the sum of what holds for it in UTF-8."""
    out = [0] * 256
    for kind, *ranges in (
        (_BREAK, (0x0A, 0x0A), (0x20, 0x20)),
        (_LINE_END, (0x0A, 0x0A)),
        # Begins a character that is surely not white space, which is below 0x21 or begins with C2, E1, E2 or E3.
        (_SOLID, (0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4)),
        (_MARK, (0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
        (_LETTER, (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
        # After the lead byte C3: letters, all but the signs of multiplication and division.
        (_LATIN, (0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF)),
        (_LATIN_LEAD, (0xC3, 0xC3)),
    ):
        for a, z in ranges:
            for b in range(a, z + 1):
                out[b] |= kind
    return bytes(out)


_BREAK, _LINE_END, _SOLID, _MARK, _LETTER, _LATIN, _LATIN_LEAD = (1 << k for k in range(7))
_CLASSES = _classes()


def _byte_characters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def _piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, ascending; data: their UTF-8 bytes, starts: where non-empty ones begin.

    A byte-level pre-tokenizer ends a part at each of these places, whatever comes before or after:
    where the last white space of several begins, after a line end that is this white space, and
    where marks follow a letter or digit.
    """
    kind = np.frombuffer(data.tobytes().translate(_CLASSES), np.uint8)
    cut = np.zeros(len(data) + 1, bool)
    cut[: len(data) - 1] = (kind[:-1] & _BREAK) & (kind[1:] >> 2 & 1)  # _SOLID is the third bit
    cut[1:] |= cut[:-1] & (kind & _LINE_END != 0)
    letter = kind & _LETTER != 0
    letter[1:] |= (kind[1:] & _LATIN != 0) & (kind[:-1] & _LATIN_LEAD != 0)
    cut[1:-1] |= (kind[1:] & _MARK != 0) & letter[:-1]
    cut[starts] = True
    return cut[:-1].nonzero()[0]


#: Bytes of pieces that fit two numbers, which are looked up by column, beside their count in the last byte.
_SHORT = 15
_FIRST, _SECOND, _FOLD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: By how many bytes a piece has, last for all above _SHORT: those of its 16 that count, and what is put beside them.
_MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(_SHORT + 1)] + [[0, 0]], np.uint64)
_COUNTS = np.arange(_SHORT + 2, dtype=np.uint64) << np.uint64(56)


class _Pieces:
    """Numbers pieces, given as bytes, from 0 on in the order in which they come; finds the numbers of a whole column at once.

    Pieces of up to _SHORT bytes, nearly all, are two numbers that hold their bytes, in a table with open addressing.
    """

    def __init__(self):
        self.long: dict[bytes, int] = {}
        self.size = 0
        self._room(1 << 16)

    def __len__(self) -> int:
        return self.size

    def __contains__(self, piece: str) -> bool:
        data = np.frombuffer(piece.encode(), np.uint8)
        return piece.encode() in self.long if len(data) > _SHORT else bool(self.find(self.keys_of(data, np.zeros(1, np.int64), np.array([len(data)])))[0] >= 0)

    def _room(self, slots: int) -> None:
        # A row whose second number is 0 is free.
        self.keys, self.numbers = np.zeros((slots, 2), np.uint64), np.zeros(slots, np.int32)

    @staticmethod
    def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Two numbers for each piece of these bytes; longer ones than _SHORT get two that are never in the table."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        keys = np.ndarray(len(data) + 1, "V16", padded, strides=(1,))[starts].view("<u8").astype(np.uint64, copy=False).reshape(-1, 2)
        size = np.minimum(sizes, _SHORT + 1)
        keys &= _MASKS.take(size, axis=0)
        keys[:, 1] |= _COUNTS.take(size)
        return keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _FIRST
        h ^= keys[:, 1] * _SECOND
        h ^= h >> np.uint64(32)
        h *= _FOLD
        h >>= np.uint64(65 - len(self.keys).bit_length())
        return h.view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that are not there."""
        slot, out = self._slots(keys), np.full(len(keys), -1, np.int32)
        held = self.keys.take(slot, axis=0)
        same = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])
        np.copyto(out, self.numbers.take(slot), where=same)
        left = (~same & (held[:, 1] != 0)).nonzero()[0]
        slot, keys = slot.take(left), keys.take(left, axis=0)
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            held = self.keys.take(slot, axis=0)
            same = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])
            out[left[same]] = self.numbers.take(slot[same])
            more = (~same & (held[:, 1] != 0)).nonzero()[0]
            left, slot, keys = left.take(more), slot.take(more), keys.take(more, axis=0)
        return out

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Into free rows; keys that are not there, each once."""
        slot = self._slots(keys)
        while len(slot):
            free = (self.keys[slot, 1] == 0).nonzero()[0]
            self.numbers[slot[free]] = numbers[free]
            free = free[self.numbers[slot[free]] == numbers[free]]  # of several for one row, the one written last
            self.keys[slot[free]] = keys[free]
            left = np.ones(len(slot), bool)
            left[free] = False
            slot, keys, numbers = (slot[left] + 1) & (len(self.keys) - 1), keys[left], numbers[left]

    def add(self, keys: np.ndarray, long: list[bytes], numbers: np.ndarray, long_numbers: list[int]) -> None:
        """New pieces, each once: short ones by their keys and long ones, with their numbers."""
        self.long.update(zip(long, long_numbers, strict=True))
        self.size += len(keys) + len(long)
        if 5 * self.size > 3 * len(self.keys):
            there = self.keys[:, 1].nonzero()[0]
            old, of_old = self.keys[there], self.numbers[there]
            self._room(1 << (2 * self.size).bit_length())
            self._put(old, of_old)
        self._put(keys, numbers)

    def only(self, keep: np.ndarray) -> _Pieces:
        """Those of the numbers where keep holds, numbered anew in their order."""
        there = self.keys[:, 1].nonzero()[0]
        there, out = there[keep[self.numbers[there]]], _Pieces()
        number = (np.cumsum(keep) - 1).astype(np.int32)
        long = [w for w, k in self.long.items() if keep[k]]
        out.add(self.keys[there], long, number[self.numbers[there]], [int(number[self.long[w]]) for w in long])
        return out


class PieceTokenizer:
    """The ids of the tokenizers library, computed once for each piece of text between places where its pre-tokenizer cuts.

    Batches with an added token's string in a text go to the library whole, as do all if the file's
    tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids of 65536 and more do not fit the files")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        characters = _byte_characters()
        self.written = np.array([ord(characters[b]) for b in range(256)], "<u4")
        # The same model on words that are written in the vocabulary's characters already, after spaces or before line ends.
        # Where no token reaches from one such word into the next, it takes many words as one part.
        inner, vocabulary = {characters[b] for b in _PLAIN_BYTES}, self.library.get_vocab()
        self.words, self.marked = {}, {}
        for mark, how in ((" ", "merged_with_next"), ("\n", "isolated")):
            character = characters[ord(mark)]
            joint = [t for t in vocabulary if character in t[mark == " " :] and t.strip(character) and {*t} - {character} <= inner]
            self.words[mark] = Split(character, how) if joint else Split("\n", "isolated")  # which is no character of the vocabulary's
            self.marked[mark] = np.zeros(65536, bool)
            self.marked[mark][[i for t, i in vocabulary.items() if t.startswith(character)]] = True
        self._remember(_Pieces(), np.zeros(0, np.uint16), np.zeros(1, np.int32), np.zeros(0, np.int32))

    def _remember(self, pieces: _Pieces, ids: np.ndarray, at: np.ndarray, uses: np.ndarray) -> None:
        """Knows these pieces only, whose ids follow one another from at on."""
        # The number of a piece; by number, where its ids begin in pool and how often it was looked up. The last one ends the pool.
        self.known, self.pool, self.at, self.uses = pieces, ids, at, uses

    def _forget(self) -> None:
        """Keeps pieces that were looked up for several chunks, half of all at most."""
        n = len(self.known)
        uses, all_of = self.uses[:n], np.diff(self.at[: n + 1])
        keep, least = uses > 1, 2
        while keep.sum() > _REMEMBERED // 2 or all_of[keep].sum() > _REMEMBERED_IDS // 2:
            least *= 2
            keep = uses >= least
        ids = self.pool[: self.at[n]][np.repeat(keep, all_of)]
        at = np.concatenate([[0], np.cumsum(all_of[keep])]).astype(np.int32)
        self._remember(self.known.only(keep), ids, at, uses[keep] // 2)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words of _PLAIN, in one call; all begin with a space, or none, as mark says."""
        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if mark == "\n":
            words = pc.binary_join_element_wise(words, "", mark)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        written = self.written[np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].tobytes().decode("utf-32-le")
        edges = [*(offsets[:-1:_WORDS_AT_ONCE] - offsets[0]).tolist(), len(written)]
        pre = self.library.pre_tokenizer
        self.library.pre_tokenizer = self.words[mark]  # a second vocabulary would take 20 MB
        try:
            parts = self.library.encode_batch_fast([written[a:z] for a, z in zip(edges, edges[1:], strict=False)], add_special_tokens=False)
        finally:
            self.library.pre_tokenizer = pre
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in parts])
        # A token has the mark in no other place than at its beginning.
        at = self.marked[mark][ids].nonzero()[0]
        if mark == " ":
            return ids, np.diff(at, append=len(ids))
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _learn(self, pieces: pa.Array, keys: np.ndarray) -> np.ndarray:
        """Remembers the ids of new pieces, each once, with their keys; returns their numbers."""
        is_plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        spaced = pc.starts_with(pieces, " ").to_numpy(zero_copy_only=False)
        kinds = [(is_plain & spaced).nonzero()[0], (is_plain & ~spaced).nonzero()[0], (~is_plain).nonzero()[0]]
        order, n = np.concatenate(kinds), len(self.known)
        others = self._library(pieces.take(pa.array(kinds[2])).to_pylist())
        (ids, size), (more, sizes) = (self._plain(pieces.take(pa.array(k)), mark) for k, mark in zip(kinds, " \n", strict=False))
        ids = np.concatenate([ids, more, np.frombuffer(b"".join(others), "<u2")])
        size = np.concatenate([size, sizes, np.array([len(o) // 2 for o in others], np.int64)])
        if len(size) != len(order):
            raise ValueError("the tokenizer joins words")
        base, upto = int(self.at[n]), n + len(order)
        if upto >= len(self.at):
            self.at, self.uses = (np.concatenate([v[: n + 1], np.zeros(upto, np.int32)]) for v in (self.at, self.uses))
        if base + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:base], np.zeros(base + 2 * len(ids), np.uint16)])
        self.pool[base : base + len(ids)] = ids
        self.at[n + 1 : upto + 1] = base + np.cumsum(size)
        self.uses[n:upto] = 0
        numbers = np.empty(len(order), np.int32)
        numbers[order] = np.arange(n, upto)
        short = pc.binary_length(pieces).to_numpy() <= _SHORT
        long = (~short).nonzero()[0]
        self.known.add(keys[short], pieces.take(pa.array(long)).cast(pa.binary()).to_pylist(), numbers[short], numbers[long].tolist())
        return numbers

    def _numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The numbers of the pieces that begin there, after those that are new have been learnt."""
        ends = np.append(starts, len(data)).astype(np.int32)
        sizes = np.diff(ends)
        keys = self.known.keys_of(data, starts, sizes)
        number = self.known.find(keys)
        rest = (number < 0).nonzero()[0]
        if not len(rest):
            return number
        pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).take(pa.array(rest)).dictionary_encode()
        distinct, which = pieces.dictionary, pieces.indices.to_numpy()
        found = np.full(len(distinct), -1, np.int32)
        long = (pc.binary_length(distinct).to_numpy() > _SHORT).nonzero()[0]
        found[long] = [self.known.long.get(w, -1) for w in distinct.take(pa.array(long)).cast(pa.binary()).to_pylist()]
        new = (found < 0).nonzero()[0]
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[which] = rest
            found[new] = self._learn(distinct.take(pa.array(new)), keys[one[new]])
        number[rest] = found[which]
        return number

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, u16 little-endian."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has) of an array of strings without nulls."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        if not self.by_piece or any(a in raw for raw in [data.tobytes()] for a in self.added):
            parts = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(parts), "<u2"), np.array([len(p) // 2 for p in parts], np.int64)
        offsets = offsets - offsets[0]
        starts = _piece_starts(data, offsets[:-1][offsets[1:] > offsets[:-1]])
        if len(self.known) > _REMEMBERED or self.at[len(self.known)] > _REMEMBERED_IDS:
            self._forget()
        number = self._numbers(data, starts)
        self.uses[number] += 1
        n = len(self.known)
        known = pa.ListArray.from_arrays(pa.array(self.at[: n + 1]), pa.array(self.pool[: self.at[n]]))
        ids = known.take(pa.array(number))
        upto = ids.offsets.to_numpy()
        return ids.flatten().to_numpy(), np.diff(upto[np.searchsorted(starts, offsets)]).astype(np.int64)


@cache
def keep_freed_memory() -> None:
    """Lets this worker use its memory again instead of giving it back after each array and having pages cleared anew; glibc only."""
    import ctypes

    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError, TypeError):
        return
    trim_threshold, mmap_threshold = -1, -3
    mallopt(trim_threshold, 1 << 27)
    mallopt(mmap_threshold, 1 << 25)


def tokenizer_at(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def _together(blocks: list) -> list[list]:
    """The blocks that are coded together."""
    groups = max(1, round(len(blocks) / FILE_BLOCKS))
    edges = [len(blocks) * k // groups for k in range(groups + 1)]
    return [blocks[a:z] for a, z in zip(edges, edges[1:], strict=False)]


def pack_file(names: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents: their doc_ids, how many ids each has, all ids one after the other."""
    # Blocks of one size to within an id, so that none is coded alone.
    blocks = np.array_split(ids, -(-len(ids) // BLOCK_IDS))
    records = [r for some in _together(blocks) for r in encode_blocks(some)]
    index = b"".join(
        (
            np.array([d or 0 for d in names], "<i8").tobytes(),
            sizes.astype("<u8").tobytes(),
            np.array([d is None for d in names], np.uint8).tobytes(),
            np.array([len(r) for r in records], "<u4").tobytes(),
        )
    )
    return _HEAD.pack(_MAGIC, _VERSION, len(names), len(records), zlib.crc32(index)) + index + b"".join(records)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What pack_file() was given; raises ValueError if the file is damaged."""
    magic, version, n, blocks, crc = _HEAD.unpack_from(data)
    index = data[_HEAD.size : _HEAD.size + 17 * n + 4 * blocks]
    if (magic, version) != (_MAGIC, _VERSION) or zlib.crc32(index) != crc:
        raise ValueError("not a token file, or its index is damaged")
    names, sizes = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n)
    null, lengths = np.frombuffer(index, np.uint8, n, 16 * n), np.frombuffer(index, "<u4", blocks, 17 * n)
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) + _HEAD.size + len(index)
    records = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    ids = np.concatenate([x for some in _together(records) for x in decode_blocks(some)])
    return [None if z else d for d, z in zip(names.tolist(), null.tolist(), strict=True)], sizes.astype(np.int64), ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids to folder, a URI that all executors can write to; returns (file, documents, ids).

    Null texts count as empty: only their end id is written. Null ids come first. Repeated rows are
    written as often as they occur, and rows with one id in the order in which Spark reads them, so
    that an id that many rows share does not meet in one task. A text of any length is tokenized
    whole. An empty table writes no file. Only doc_id and text are read, so other columns may have
    any name.
    """
    path = public_tokenizers.path(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.col("row").asc()
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        tokens = tokenizer_at(path)
        part, made, full = TaskContext.get().partitionId(), 0, FILE_BLOCKS * BLOCK_IDS
        names, sizes, ids = [], np.zeros(0, np.int64), np.zeros(0, np.uint16)

        def flush(documents: int) -> pa.RecordBatch:
            """Writes the first documents and keeps the others."""
            nonlocal made, names, sizes, ids
            name, size = f"part-{part:06d}-{made:06d}.tokens", int(sizes[:documents].sum())
            pa.default_memory_pool().release_unused()
            store_bytes(folder, name, pack_file(names[:documents], sizes[:documents], ids[:size]))
            made, names, sizes, ids = made + 1, names[documents:], sizes[documents:], ids[size:]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, documents, size)], ["file", "documents", "ids"])

        for b in batches:
            cuts = np.cumsum(pc.binary_length(b.column(1)).to_numpy()) // _CHUNK_CHARS
            edges = [0, *(np.diff(cuts).nonzero()[0] + 1).tolist(), b.num_rows]
            for a, z in zip(edges, edges[1:], strict=False):
                new, size = tokens.encode_column(b.column(1).slice(a, z - a))
                ends = np.cumsum(size + 1) - 1
                with_ends, mine = np.full(len(new) + len(size), end_id, np.uint16), np.ones(len(new) + len(size), bool)
                mine[ends] = False
                with_ends[mine] = new
                names += b.column(0).slice(a, z - a).to_pylist()
                sizes, ids = np.concatenate([sizes, size + 1]), np.concatenate([ids, with_ends])
                while 2 * len(ids) > 3 * full and len(names) > 1:
                    yield flush(max(1, int(np.searchsorted(np.cumsum(sizes), full, "right"))))
        if names:
            yield flush(len(names))

    return materialise(rows.drop("row").mapInArrow(giving_back(run), "file string, documents long, ids long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(file, place, doc_id, start, n_tokens, ids_crc32, ids) of every document in folder.

    start counts the ids before it in its file; ids (array of int) only if asked for.
    """
    schema = "file string, place int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                documents, sizes, ids = unpack_file(data.as_py())
                upto, raw = np.concatenate([[0], np.cumsum(sizes)]), memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = (4 * upto).tolist()
                cols = [
                    pa.array([path.as_py().rpartition("/")[2]] * len(documents)),
                    pa.array(np.arange(len(documents), dtype=np.int32)),
                    pa.array(documents, pa.int64()),
                    pa.array(upto[:-1]),
                    pa.array(sizes),
                    pa.array([zlib.crc32(raw[a:z]) for a, z in zip(at, at[1:], strict=False)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    return files.select("path", "content").mapInArrow(giving_back(run), schema)


def round_trip(docs: DataFrame, name: str = "tokens") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of docs, from files that it writes to the shared folder and reads back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not write_token_files(docs, folder).limit(1).count():
        return spark.createDataFrame([], schema)
    rows = materialise(read_token_files(spark, folder, with_ids=False), "token-digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_all"))
    # One row for each file of about two million ids.
    upto = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_before"))
    files = checked_broadcast(materialise(files, "token-offsets"))
    out = rows.join(files, F.col("file") == F.col("_file"))
    return out.select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files: where its ids start, how many they are and their CRC-32."""
    return round_trip(table(spark, sf_dir, "documents"))
