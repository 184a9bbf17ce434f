"""Byte-level BPE encoding and decoding with a rank queue over hierarchical bitmaps.

A pre-token's bytes form a linked list. For every neighbouring pair that is a token, the
pair's rank has a bucket that holds the left positions. Which ranks have a bucket is
kept in bitmaps of two levels, so the next rank to merge is a find-first-set on each
level. Entries are not removed when a merge changes their pair; they are recognised
as stale when they come up. A pre-token of n bytes takes O(n log n) steps at most. The new pre-tokens
of a group of texts share one queue, so the cost of finding a rank is shared too.
"""

from __future__ import annotations

import base64
import struct
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate

import regex

_LEAF = 8  # a leaf of the bitmap covers 256 ranks
_PLACE = (1 << _LEAF) - 1


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of pre-tokens: the pair of lowest rank merges first, the leftmost of equal ones.

    All pre-tokens share one linked list and one queue, which no pair across a border ever enters, so a rank that is due
    takes its bucket's positions in one go, and goes on later if a merge brings up a smaller rank.
    """
    text, starts = b"".join(pieces), list(accumulate(map(len, pieces), initial=0))
    n, get = len(text), ranks.get
    border = bytearray(n + 1)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n))  # begin of the part to the left
    pending = [get(text[i:i + 2]) for i in range(n)]  # rank of the pair that begins here, None if there is none
    for at in starts:
        border[at] = 1
        if at:
            pending[at - 1] = None
    buckets: defaultdict[int, list[int]] = defaultdict(list)  # a heap of positions by rank
    for i, rank in enumerate(pending):
        if rank is not None:
            buckets[rank].append(i)
    leaves, top = [0] * ((max(ranks.values(), default=0) >> _LEAF) + 1), 0
    for rank in buckets:
        leaves[rank >> _LEAF] |= 1 << (rank & _PLACE)
        top |= 1 << (rank >> _LEAF)
    while top:
        leaf = (top & -top).bit_length() - 1
        bits = leaves[leaf]
        due = leaf << _LEAF | (bits & -bits).bit_length() - 1
        bucket, least = buckets[due], due
        while bucket and least == due:
            i = heappop(bucket)
            if pending[i] != due:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            pending[j] = None
            if border[stop]:
                pending[i] = None
            else:
                before[stop] = i
                rank = pending[i] = get(text[i:end[stop]])
                if rank is not None:
                    if not buckets[rank]:
                        leaves[rank >> _LEAF] |= 1 << (rank & _PLACE)
                        top |= 1 << (rank >> _LEAF)
                    heappush(buckets[rank], i)
                    if rank < least:
                        least = rank
            if not border[i]:
                left = before[i]
                rank = get(text[left:stop])
                if rank != pending[left]:
                    pending[left] = rank
                    if rank is not None:
                        if not buckets[rank]:
                            leaves[rank >> _LEAF] |= 1 << (rank & _PLACE)
                            top |= 1 << (rank >> _LEAF)
                        heappush(buckets[rank], left)
                        if rank < least:
                            least = rank
        if not bucket:
            leaves[leaf] &= ~(1 << (due & _PLACE))
            if not leaves[leaf]:
                top &= ~(1 << leaf)
    out = []
    for piece, i, stop in zip(pieces, starts, starts[1:]):
        whole = get(piece)  # a pre-token that is a token stays whole
        ids = [] if whole is None else [whole]
        while whole is None and i < stop:
            ids.append(ranks[text[i:end[i]]])
            i = end[i]
        out.append(ids)
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    return merge_all([piece], ranks)[0]


class Codec:
    """Encodes whole texts by a pattern and byte ranks; decodes ids."""

    #: Pre-tokens that are remembered, and up to which length.
    MOST, LONGEST = 800_000, 64
    #: Texts of about so many characters share a queue.
    TOGETHER = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= self.TOGETHER:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        known, found = self.known, [self.find(t) for t in texts]
        new = [p for p in set().union(*found) if p not in known]
        room = self.MOST - len(known)
        known.update(zip(new, (struct.pack(f"<{len(ids)}I", *ids) for ids in merge_all([p.encode() for p in new], self.ranks))))
        out = [b"".join(map(known.__getitem__, f)) for f in found]
        keep = 0
        for p in new:
            if len(p) <= self.LONGEST and keep < room:
                keep += 1
            else:
                del known[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file that every executor has installed, made once a worker."""
    with open(path, "rb") as lines:
        return Codec(read_ranks(lines), pattern)
