"""Byte-pair encoding of many texts at once, by an index of pair occurrences (pure Python).

A block of texts is cut into pretokens by the vocabulary's pattern. Of the distinct pretokens not
met before, all symbols lie in one array with links to their neighbours; the index maps each pair
that is a merge to all its positions in that array. Active ranks are applied in ascending order:
all positions of a pair merge at once and only the neighbours' entries change. Pretokens don't
overlap, so the order inside each is that of the usual one-by-one encoding.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import regex

#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens kept with their ids between blocks; beyond it the memory is emptied.
REMEMBERED = 400_000
#: Longest pretoken (bytes) that is remembered.
SHORT = 64


class PairIndexEncoder:
    """Encodes without special tokens: their strings in a text are ordinary text."""

    def __init__(self, rank_lines: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_lines.splitlines()) if token}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("not a byte-level vocabulary: a single byte has no id")
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.merge_of: dict[tuple[int, int], int] = {}

    def _merge(self, a: int, b: int) -> int:
        """Rank of the pair (a, b), or -1; remembered, bounded by the pairs that occur."""
        r = self.merge_of.get((a, b))
        if r is None:
            if len(self.merge_of) > 4 * REMEMBERED:
                self.merge_of.clear()
            r = self.merge_of[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode_pretokens(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the distinct ``words``."""
        symbol: list[int] = []
        starts: list[int] = []
        single = self.single
        for w in words:
            starts.append(len(symbol))
            symbol.extend(single[b] for b in w.encode("utf-8", "surrogatepass"))
            symbol.append(-1)  # a wall between words
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        positions: dict[int, list[int]] = {}
        merge = self._merge
        for i in range(n - 1):
            a, b = symbol[i], symbol[i + 1]
            if a >= 0 and b >= 0 and (r := merge(a, b)) >= 0:
                positions.setdefault(r, []).append(i)
        active = list(positions)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            at = positions.pop(rank)
            at.sort()
            for i in at:
                if symbol[i] < 0:
                    continue
                j = after[i]
                if j >= n or symbol[j] < 0 or merge(symbol[i], symbol[j]) != rank:
                    continue  # this occurrence is gone: a neighbour was merged away
                symbol[i] = rank
                symbol[j] = -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbol[k] >= 0 and (r := merge(rank, symbol[k])) >= 0:
                        if r not in positions:
                            positions[r] = []
                            heapq.heappush(active, r)
                        positions[r].append(i)
                h = before[i]
                if h >= 0 and symbol[h] >= 0 and (r := merge(symbol[h], rank)) >= 0:
                    if r not in positions:
                        positions[r] = []
                        heapq.heappush(active, r)
                    positions[r].append(h)
        out = []
        for s in starts:
            ids, i = [], s
            while symbol[i] != -1:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give the empty list."""
        cut = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = dict.fromkeys(w for words in cut for w in words if w not in known)
        fresh = dict(zip(new, self.encode_pretokens(list(new)))) if new else {}
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known.get(w) or fresh[w]
            out.append(ids)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= SHORT)
        return out
