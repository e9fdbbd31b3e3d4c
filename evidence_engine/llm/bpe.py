"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Adjacent pairs wait in buckets, one per merge rank, each holding positions of the linked list of
parts of one long pre-token or of many short ones laid end to end. A hierarchical bitmap marks the
ranks whose bucket is not empty, so the next rank is two find-first-set steps whatever the length.
Entries that a merge has made stale are skipped when they come up. Work and memory are nearly
linear in the length.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import freed, plain, settle

#: White space as Unicode has it (fixed values); Python's own class also holds U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class _Pairs(dict):
    """Rank of the token that two tokens make, -1 for none; looked up when first asked for."""

    def __init__(self, ranks):
        self.ranks, self.vocabulary = ranks, {v: k for k, v in ranks.items()}

    def __missing__(self, pair):
        if len(self) > 250_000:
            self.clear()
        self[pair] = rank = self.ranks.get(self.vocabulary[pair >> 20] + self.vocabulary[pair & 0xFFFFF], -1)
        return rank


_BIT = [1 << i for i in range(256)]
#: Bytes of pre-tokens merged together: they share one rank queue, so a rank comes up once for all of them. So few
#: stay in the processor's cache. A longer pre-token is a run of its own; beyond LONG it is held in packed arrays.
RUN, LONG = 1 << 15, 1 << 18


class Merger:
    """Merges pre-tokens laid end to end. The rank queue is `low` (a 256-bit word for each 256 ranks), a word on top
    of those, and a bucket of positions for each rank that waits; it is empty between calls. Pairs never reach across a
    pre-token's border, so each pre-token sees its own ranks in ascending order whatever stands beside it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, _Pairs(ranks)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.double = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank
        self.low = [0] * (max(ranks.values(), default=0) // 256 + 1)

    def merge(self, piece: bytes) -> list[int]:
        return self.merge_all([piece])[0].tolist()

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces laid end to end, and the number of each piece's ids."""
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int32, len(pieces))
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rest = np.flatnonzero((whole < 0) & (length > 0))
        upto = np.concatenate([[0], np.cumsum(length[rest])])
        merged, sizes, a = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while a < len(rest):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + RUN, "right")) - 1)
            ids, n = self._merge_run(b"".join([pieces[k] for k in rest[a:b].tolist()]), upto[a + 1 : b + 1] - upto[a])
            merged.append(ids)
            sizes.append(n)
            a = b
        known, sizes = np.flatnonzero(whole >= 0), np.concatenate(sizes)
        count = (whole >= 0).astype(np.int64)
        count[rest] = sizes
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        out[start[known]] = whole[known]
        out[np.repeat(start[rest] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = np.concatenate(merged)
        return out, count

    def _merge_run(self, data: bytes, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that end at `stop`, and how many each has."""
        data = np.frombuffer(data, np.uint8)
        n, start = len(data), np.concatenate([[0], stop[:-1]])
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.double[data[:-1].astype(np.int32) << 8 | data[1:]]
        ranks[stop - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[stop - 1] = before[start] = -1

        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        sorted_ranks, positions = ranks[order], order.tolist()
        cut = np.flatnonzero(np.diff(sorted_ranks, prepend=-1)).tolist() + [len(positions)]
        buckets = {int(sorted_ranks[a]): positions[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)}
        token, waiting, after, before = ((array("i", x.tobytes()) if n > LONG else x.tolist()) for x in (self.single[data], ranks, after, before))
        low, pairs, bit, top = self.low, self.pairs, _BIT, 0
        for rank in buckets:
            top |= 1 << (rank >> 8)
            low[rank >> 8] |= bit[rank & 255]

        while top:
            word = (top & -top).bit_length() - 1
            held = low[word]
            first = held & -held
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets.pop(rank)
            low[word] = held = held ^ first
            if not held:
                top &= top - 1
            if len(bucket) > 1:
                bucket.sort()
            for done, i in enumerate(bucket, 1):
                if waiting[i] != rank:
                    continue
                gone = after[i]
                end = after[gone]
                waiting[gone] = token[gone] = -1
                after[i], token[i] = end, rank
                lowest = rank
                if end >= 0:
                    before[end] = i
                    waiting[i] = pair = pairs[rank << 20 | token[end]]
                    if pair >= 0:
                        if pair in buckets:
                            buckets[pair].append(i)
                        else:
                            buckets[pair] = [i]
                            word = pair >> 8
                            top |= bit[word] if word < 256 else 1 << word
                            low[word] |= bit[pair & 255]
                        if pair < lowest:
                            lowest = pair
                else:
                    waiting[i] = -1
                left = before[i]
                if left >= 0:
                    waiting[left] = pair = pairs[token[left] << 20 | rank]
                    if pair >= 0:
                        if pair in buckets:
                            buckets[pair].append(left)
                        else:
                            buckets[pair] = [left]
                            word = pair >> 8
                            top |= bit[word] if word < 256 else 1 << word
                            low[word] |= bit[pair & 255]
                        if pair < lowest:
                            lowest = pair
                if lowest < rank and done < len(bucket):  # a lower rank goes first; the rest waits on
                    buckets[rank] = bucket[done:]
                    top |= 1 << (rank >> 8)
                    low[rank >> 8] |= bit[rank & 255]
                    break
        token = np.array(token, np.int32)
        stays = token >= 0
        return token[stays], np.diff(np.cumsum(stays)[stop - 1], prepend=0)


def _take(pool, ends, at):
    """Spans `at` of a pool laid end to end, and where each begins (and the last one ends)."""
    start = ends[at]
    sizes = ends[at + 1] - start
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return pool[np.repeat(start - upto[:-1], sizes) + np.arange(upto[-1])], upto


#: The pattern of which is known that a run of letters, with a space before it or none, is one match.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Known:
    """Spans of known chunks' ids in a pool, and of known pre-tokens' in another. New chunks are encoded together."""

    def __init__(self, ranks, pattern):
        self.merge_all = Merger(ranks).merge_all
        self.findall = regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")).findall
        self.letters = pattern == PLAIN
        self.chunks, self.pieces = {}, {}
        self.bound(-1)

    def bound(self, held):
        """Forget all chunks, or all pre-tokens, if more than `held` are known. There are fewer pre-tokens, so they stay for longer."""
        if len(self.chunks) > held:
            self.chunks, self.pool, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        if len(self.pieces) > held:
            self.pieces, self.piece_pool, self.piece_ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def split(self, chunk):
        """Matches of PLAIN; letters of other scripts are left to the pattern."""
        return [chunk] if chunk.isascii() and (chunk[1:] if chunk[0] == " " else chunk).isalpha() else self.findall(chunk)

    def learn(self, new):
        """Encode chunks that are new, each given once."""
        split = list(map(self.split if self.letters else self.findall, new))
        parts = list(chain.from_iterable(split))
        fresh = [x for x in dict.fromkeys(parts) if x not in self.pieces]
        ids, sizes = self.merge_all([x.encode() for x in fresh])
        self.pieces.update(zip(fresh, range(len(self.pieces), len(self.pieces) + len(fresh)), strict=True))
        self.piece_pool = np.concatenate([self.piece_pool, ids])
        self.piece_ends = np.concatenate([self.piece_ends, self.piece_ends[-1] + np.cumsum(sizes)])
        ids, upto = _take(self.piece_pool, self.piece_ends, np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts)))
        self.chunks.update(zip(new, range(len(self.chunks), len(self.chunks) + len(new)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts):
        """Ids of all texts laid end to end, and the number of each text's ids."""
        split = list(map(CHUNKS.findall, texts))
        chunks = list(chain.from_iterable(split))
        at = np.fromiter(map(self.chunks.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            new_chunks = [chunks[k] for k in new]
            self.learn(list(dict.fromkeys(new_chunks)))
            at[new] = np.fromiter(map(self.chunks.__getitem__, new_chunks), np.int64, len(new))
        ids, upto = _take(self.pool, self.ends, at)
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(list(map(len, split)))]).astype(np.int64)])


#: Runs of non-space with one space before them. The pattern never matches across their borders, so a
#: run's ids don't depend on what stands around it.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: Characters encoded together, and so the size of what a task hands back at a time.
GROUP = 1 << 20


def _groups(texts, limit):
    """(first row, texts) of consecutive texts of about `limit` characters together; null is empty."""
    group, size, first = [], 0, 0
    for text in texts:
        text = text.as_py() or ""
        group.append(text)
        size += len(text)
        if size > limit:
            yield first, group
            group, size, first = [], 0, first + len(group)
    if group:
        yield first, group


class _Bytes:
    """Bytes of ids."""

    def __init__(self, ranks):
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.zeros(int(self.size.sum()), np.uint8)
        for token, rank in ranks.items():
            self.data[self.start[rank] : self.start[rank] + len(token)] = np.frombuffer(token, np.uint8)

    def decode(self, ids, counts):
        """An Arrow column of the bytes of each list of ids, the lists laid end to end."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.size) and self.size[ids].min() > 0):
            raise ValueError("an id that the vocabulary lacks")
        n = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        data = self.data[np.repeat(self.start[ids] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[np.concatenate([[0], np.cumsum(counts)])]
        return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _encode(raw, pattern, held, decoding):
    def rows(batches):
        ranks = read_ranks(raw.value)
        known, back = _Known(ranks, pattern), _Bytes(ranks) if decoding else None
        gc.disable()  # many small lists and no cycles: the collector would only walk them
        try:
            for batch in batches:
                for first, texts in _groups(batch.column("text"), GROUP):
                    ids, sizes = known.encode(texts)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    out = [batch.column("doc_id").slice(first, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                    if decoding:
                        out.append(back.decode(ids, sizes))
                    known.bound(held)
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])
        finally:
            gc.enable()

    return rows


def _decode(raw):
    def rows(batches):
        back = _Bytes(read_ranks(raw.value))
        for batch in batches:
            lists = batch.column("ids")
            counts = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)  # null lists hold nothing
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), back.decode(ids, counts)], ["doc_id", "ids", "decoded"])

    return rows


def _encoded(docs, rank_file, pattern, held, decoding):
    settle(docs.sparkSession)
    with open(rank_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = plain(docs, "doc_id", "text")
    return docs.mapInArrow(freed(_encode(raw, pattern, held, decoding)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoding)


def encode(docs: DataFrame, rank_file: str, pattern: str, held: int = 200_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids array<int>, one row per row.

    Each match of `pattern` is encoded separately: the lowest rank merges first, the leftmost of
    equals first, and a match that is itself a token is that token. No special tokens. Null and empty
    texts give an empty list. Rows may repeat, doc_id may be null, other columns are ignored, an empty table gives an
    empty result. `held` bounds a task's memory of encoded words, not what it encodes; rows are handed back as soon
    as about a million characters are done. The rank file is read by the driver.
    """
    return _encoded(docs, rank_file, pattern, held, False)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, held: int = 200_000) -> DataFrame:
    """encode() and decode() in one pass over the texts: doc_id, ids, decoded. The ids alone are decoded."""
    return _encoded(docs, rank_file, pattern, held, True)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, ids, decoded binary. A null list decodes to no bytes; an id
    that the vocabulary lacks is an error."""
    with open(rank_file, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = plain(encoded, "doc_id", "ids")
    return encoded.mapInArrow(freed(_decode(raw)), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
