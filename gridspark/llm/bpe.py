"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Texts are cut into pre-tokens by numpy, each distinct pre-token that a worker has not met is merged by
the queue, and ids and decoded bytes are gathered from flat tables.  Every slice of texts is decoded and
compared with what went in.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from gridspark.llm.common import arrow_map, binary_view, give_back, slices, token_hashes

#: Fixed value: the pattern that numpy can cut by; others are left to the regex library.
CONTRACTIONS_LETTERS_NUMBERS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, WHITE, OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for every code point, as the installed tiktoken library has them.

    Its tables are of another Unicode version than those of the regex module.  It leaves out what a pattern does not match.
    """
    out, single = np.full(0x110000, OTHER, np.uint8), {bytes([i]): i for i in range(256)}
    for kind, of in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        finder = tiktoken.Encoding("class", pat_str=of, mergeable_ranks=single, special_tokens={})
        for a in range(0, 0x110000, 1 << 14):
            text = "".join(chr(c) for c in range(a, a + (1 << 14)) if not 0xD800 <= c < 0xE000)
            out[np.frombuffer(bytes(finder.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4")] = kind
    return out


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts (byte positions) of the pre-tokens of rows of UTF-8 bytes data[at[0]:at[-1]], counted from at[0]."""
    b, rows = data[at[0] : at[-1]], at - at[0]
    point = np.frombuffer(b.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    wide = len(b) != n
    if wide:
        byte = np.flatnonzero((b & 0xC0) != 0x80)  # where each code point starts
        rows = np.searchsorted(byte, rows)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    kind = _kinds()[point]
    start = first[:n].copy()  # a run of one kind, within a row
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last_white = np.zeros(n, bool)  # followed in its row by something solid
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    begin = start & ~white | start & white | last_white
    # a single space goes with what follows
    joins = last_white & (point == 32)
    begin[1:] &= ~joins[:-1]
    quote = np.flatnonzero((point[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        ahead = np.concatenate([point, [0, 0]])
        a = ahead[quote + 1]
        c = np.where(first[np.minimum(quote + 2, n)], 0, ahead[quote + 2])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (a == ord("r")) & (c == ord("e")) | (a == ord("v")) & (c == ord("e")) | (a == ord("l")) & (c == ord("l"))
        for hit, size in ((quote[one], 2), (quote[two], 3)):
            begin[hit + 1] = False
            begin[(hit + size)[hit + size < n]] = True
    out = np.flatnonzero(begin)
    return byte[out] if wide else out


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] of all i, one after the other."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]



class RankQueue:
    """Buckets of positions by merge rank; a three-level bitmap finds the lowest rank that has any.

    Words of the bitmap have 64 bits, so 262,144 ranks can be told apart with three find-first-set steps.
    """

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop_rank(self) -> tuple[int, list[int]] | None:
        """The lowest rank with all its positions, which leave the queue."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        self.low[a] = w = w & (w - 1)
        if not w:
            self.mid[b] = m = m & ~(1 << (a & 63))
            if not m:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class Codec:
    """Ranks as bytes -> id; ids are the ranks, as in a .tiktoken file.

    remembered: a worker forgets its pre-tokens when it has met so many; that costs time only.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 400_000) -> None:
        if max(ranks.values(), default=0) >= 1 << 18:
            raise ValueError("the bitmap has room for 262,144 ranks")
        self.ranks, self.pattern, self.remembered = ranks, pattern, remembered
        self.fast, self.compiled = pattern == CONTRACTIONS_LETTERS_NUMBERS, regex.compile(pattern)
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.pairs = {ranks[t[:k]] << 18 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.byte_pairs = np.array([self.pairs.get(a << 18 | b, -1) for a in self.byte_ids for b in self.byte_ids])
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        by_id = sorted((i, t) for t, i in ranks.items())
        for i, t in by_id:
            size[i] = len(t)
        self.piece_size, self.piece_start = size, np.cumsum(size) - size
        self.piece_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            made = cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, pattern)
        give_back()
        return made

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # a pre-token's hash -> its number
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, pieces: Iterable[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: in each the lowest rank merges first, and from the left among equal ones.

        All of them share a queue.  Positions are linked within a pre-token only, and pre-tokens do not
        touch each other, so it makes no difference which of them has its turn.
        """
        out: list = []
        spans, solid = [], []
        at = 0
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is None and piece:
                spans.append((len(out), at))
                solid.append(piece)
                at += len(piece)
                out.append([])
            else:
                out.append([] if whole is None else [whole])
        if not at:
            return out
        raw = np.frombuffer(b"".join(solid), np.uint8).astype(np.int64)
        last = np.cumsum([len(x) for x in solid]) - 1
        links = np.arange(1, at + 1)
        links[last] = -1
        back = np.arange(-1, at - 1)
        back[0] = -1
        back[last[:-1] + 1] = -1
        first = np.full(at, -1, np.int64)
        first[:-1] = self.byte_pairs[raw[:-1] << 8 | raw[1:]]
        first[last] = -1
        ids, nxt, prv = np.array(self.byte_ids)[raw].tolist(), links.tolist(), back.tolist()
        queue, some = RankQueue(), np.flatnonzero(first >= 0)
        order = some[np.argsort(first[some], kind="stable")]
        for positions in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            if len(positions):
                queue.push(int(first[positions[0]]), -1)
                queue.buckets[int(first[positions[0]])] = positions.tolist()
        get, push = self.pairs.get, queue.push
        while (lowest := queue.pop_rank()) is not None:
            rank, positions = lowest
            positions.sort()
            for at, i in enumerate(positions):
                if (left := ids[i]) < 0 or (j := nxt[i]) < 0 or get(left << 18 | ids[j]) != rank:
                    continue  # stale: one of its parts has been merged otherwise
                ids[i], ids[j], lower = rank, -1, False
                nxt[i] = j = nxt[j]
                if j >= 0:
                    prv[j] = i
                    if (new := get(rank << 18 | ids[j])) is not None:
                        push(new, i)
                        lower = new < rank
                if (h := prv[i]) >= 0 and (new := get(ids[h] << 18 | rank)) is not None:
                    push(new, h)
                    lower |= new < rank
                if lower:  # that one comes first; the rest of this bucket waits
                    for k in positions[at + 1 :]:
                        push(rank, k)
                    break
        for k, i in spans:
            parts = out[k]
            while i >= 0:
                parts.append(ids[i])
                i = nxt[i]
        return out

    def encode_rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of UTF-8 bytes data[at[0]:at[-1]], and where the ids of each row start (and the last end)."""
        raw, rows = data[at[0] : at[-1]], at - at[0]
        if self.fast:
            start = cuts(data, at)
        else:
            start = np.array([r + k for a, z in zip(rows, rows[1:], strict=False) for r, t in [(a, raw[a:z].tobytes().decode())] for k in np.cumsum([0, *(len(p.encode()) for p in self.compiled.findall(t))])[:-1]], np.int64)
        end = np.append(start[1:], len(raw))
        h, which = np.unique(token_hashes(raw, start, end), return_inverse=True)
        first = np.empty(len(h), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.known) > self.remembered:
            self.forget()
        known = self.known
        number = [known.get(x, -1) for x in h.tolist()]
        if new := [k for k, x in enumerate(number) if x < 0]:
            blob, base = raw.tobytes(), len(known)
            found = self.merge([blob[start[i] : end[i]] for i in first[new].tolist()])
            for k, x in zip(new, h[new].tolist(), strict=True):
                known[x] = number[k] = base
                base += 1
            self.sizes = np.concatenate([self.sizes, [len(x) for x in found]])
            self.ids = np.concatenate([self.ids, np.array([y for x in found for y in x], np.int32)])
            self.starts = np.cumsum(self.sizes) - self.sizes
        which = np.array(number, np.int64)[which] if len(h) else np.zeros(0, np.int64)
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        size = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        return gathered(self.ids, self.starts[which], size), ends[np.searchsorted(start, rows)]

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where the bytes of each row start (and the last end)."""
        size = self.piece_size[ids]
        return gathered(self.piece_bytes, self.piece_start[ids], size), np.concatenate([[0], np.cumsum(size)])[at]

    def checked(self, column: pa.Array) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of a text column: ids, their row starts, decoded bytes, their row starts; equal to the texts."""
        data, at = binary_view(column)
        for a, z in slices(at):
            own = at[a : z + 1]
            ids, starts = self.encode_rows(data, own)
            back, back_at = self.decode_rows(ids, starts)
            if not (np.array_equal(back, data[own[0] : own[-1]]) and np.array_equal(back_at, own - own[0])):  # two pre-tokens with one hash
                self.forget()
                raw = [data[x:y].tobytes() for x, y in zip(own, own[1:], strict=False)]
                each = [[i for p in self.merge([q.encode() for q in self.compiled.findall(r.decode())]) for i in p] for r in raw]
                ids, starts = np.array([i for x in each for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each])])
                back, back_at = self.decode_rows(ids, starts)
            yield ids, starts, back, back_at

    def encode(self, text: str | None) -> list[int]:
        return [i for ids, *_ in self.checked(pa.array([text or ""])) for i in ids.tolist()]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        ids = np.fromiter(ids, np.int64)
        return self.decode_rows(ids, np.array([0, len(ids)]))[0].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text; null and empty texts have no ids.

    path: the rank file, which every executor must have at that place (or ship it with the job).
    """

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        ids = [ids[a:z] for ids, at, *_ in c.checked(batch.column(1)) for a, z in zip(at, at[1:], strict=False)]
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (the bytes that the ids stand for); null ids have no bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        return {"doc_id": batch.column(0), "data": pa.array([c.decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text: encoded and decoded again in one pass.

    Null and empty texts have no tokens and the digests of no bytes; repeated rows are kept, an empty
    table gives no rows, other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        counts, ids_hash, decoded = [], [], []
        for ids, at, back, back_at in c.checked(batch.column(1)):
            ids = ids.astype("<u4")
            for a, z, x, y in zip(at, at[1:], back_at, back_at[1:], strict=False):
                counts.append(z - a)
                ids_hash.append(hashlib.sha256(ids[a:z]).hexdigest())
                decoded.append(hashlib.sha256(back[x:y]).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_hash, "decoded_sha256": decoded}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
