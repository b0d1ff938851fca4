"""Byte-level BPE over ragged numpy arrays, from a public tokenizer's JSON file.

Texts are split into pre-tokens by the byte-level rule (contractions, an optional space before a run of letters,
numbers or other signs, runs of white space) with array operations; each distinct pre-token of a batch, told by a hash
and then by its bytes, is merged once. Merging is rank-synchronous: in each round every live sequence applies its lowest-ranked pair at all its
places (left to right where they overlap); a sequence without a known pair leaves the round with its symbols.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from texlith.llm._common import SLICE_BYTES, same_spans, slices, span_hashes

_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 0
#: Unicode White_Space (fixed values).
_WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that the pre-tokenizer splits off (fixed values).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    out = np.array([{"L": _LETTER, "N": _NUMBER}.get(c, _OTHER) for c in first], np.uint8)
    out[_WHITE_SPACE] = _WHITE
    return out


def pre_token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of texts that begin at `firsts` (none of them empty)."""
    n = len(points)
    kind = _classes()[points]
    new = np.zeros(n + 1, bool)
    new[firsts] = True
    new[n] = True
    start = new.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # The last sign of a white-space run parts from the rest if a text goes on; a blank joins what follows.
    last = np.flatnonzero((kind == _WHITE) & start[1:] & ~new[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quotes = np.flatnonzero((points == 39) & start[:n])
    for ending in _ENDINGS:
        at = quotes[quotes + len(ending) < n]
        for i, c in enumerate(ending, 1):
            at = at[(points[at + i] == ord(c)) & ~new[at + i]]
        start[at + 1] = False
        start[at + len(ending) + 1] = True
    start |= new
    return np.flatnonzero(start[:n])


class ByteBpe:
    """Ids and counts of texts, as the library gives them without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.byte_ids = np.array([vocab[signs[b]] for b in range(256)], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.made = made.astype(np.int32)
        self.bits = max(10, len(pairs).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        keys = left << 32 | right
        slots = self._slot(keys)
        for key, slot, rank in zip(keys.tolist(), slots.tolist(), range(len(pairs)), strict=True):
            while self.keys[slot] >= 0:
                if self.keys[slot] == key:
                    break
                slot = (slot + 1) & ((1 << self.bits) - 1)
            else:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive in each of the sequences that begin at `firsts` (none empty), and where they begin."""
        n = len(firsts)
        lengths = np.diff(np.append(firsts, len(symbols)))
        owner = np.repeat(np.arange(n), lengths)
        done_symbols, done_owner = [], []
        symbols = symbols.astype(np.int32)
        ranks = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            ranks[:-1][owner[1:] != owner[:-1]] = _NONE
        while len(symbols):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(begin, len(owner)))
            lowest = np.repeat(np.minimum.reduceat(ranks, begin), length)
            over = lowest == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                live = ~over
                symbols, owner, ranks, lowest = symbols[live], owner[live], ranks[live], lowest[live]
                if not len(symbols):
                    break
            chosen = ranks == lowest
            at = np.flatnonzero(chosen)
            touching = np.flatnonzero(at[1:] == at[:-1] + 1)
            if len(touching):  # aaa: every other one of a run, from its left
                fresh = np.append(True, at[1:] != at[:-1] + 1)
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, owner, ranks, changed = symbols[keep], owner[keep], ranks[keep], changed[keep]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            inner = again[again + 1 < len(symbols)]
            ranks[again] = _NONE
            fresh_ranks = self.pair_ranks(symbols[inner], symbols[inner + 1])
            ranks[inner] = np.where(owner[inner] == owner[inner + 1], fresh_ranks, _NONE)
        all_symbols = np.concatenate(done_symbols) if done_symbols else symbols
        all_owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(all_owner, kind="stable")
        return all_symbols[order], np.searchsorted(all_owner[order], np.arange(n + 1))

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
        """Texts cut at special strings: the parts, their text, and (part, id) of the specials that follow parts."""
        parts, owner, after = [], [], []
        for i, text in enumerate(texts):
            held = [text]
            for mark, id_ in self.special.items():
                if mark in text:
                    cut = []
                    for x in held:
                        if isinstance(x, int):
                            cut.append(x)
                            continue
                        for k, y in enumerate(x.split(mark)):
                            cut += [id_] * bool(k) + [y]
                    held = cut
            for x in held:
                if isinstance(x, int):
                    after.append((len(parts) - 1, x))
                else:
                    parts.append(x)
                    owner.append(i)
        return parts, np.array(owner, np.int64), after

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the distinct pre-tokens, where they begin, each pre-token's distinct one, each part's first pre-token."""
        full = [p for p in parts if p]
        if not full:
            return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(parts) + 1, np.int64)
        joined = "".join(full)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        firsts = np.cumsum([0] + [len(p) for p in full[:-1]])
        starts = pre_token_starts(points, firsts)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.append(0, np.cumsum(width))
        raw = joined.encode("utf-8", "replace")
        data = np.frombuffer(raw, np.uint8)
        begin, end = at[starts], at[np.append(starts[1:], len(points))]
        length = end - begin
        _, example, which = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        alike = length == length[example][which]
        alike[alike] = same_spans(raw, begin[alike], begin[example][which[alike]], length[alike])
        other = np.flatnonzero(~alike)  # of the same hash only: each is its own example
        which[other] = len(example) + np.arange(len(other))
        example = np.append(example, other)
        begin, length = begin[example], length[example]
        first = np.append(0, np.cumsum(length))
        place = np.arange(first[-1]) - np.repeat(first[:-1] - begin, length)
        symbols, bounds = self.merge(self.byte_ids[data[place]], first[:-1])
        lengths = iter(np.diff(np.append(np.searchsorted(starts, firsts), len(starts))).tolist())
        counts = [next(lengths) if p else 0 for p in parts]
        return symbols, bounds, which, np.append(0, np.cumsum(counts))

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        out = np.zeros(len(texts), np.int64)
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            parts, owner, after = self._segments(texts[a:b])
            _, bounds, which, first = self._encode(parts)
            total = np.append(0, np.cumsum(np.diff(bounds)[which] if len(which) else []))
            np.add.at(out, a + owner, (total[first[1:]] - total[first[:-1]]).astype(np.int64))
            np.add.at(out, [a + owner[p] for p, _ in after], 1)
        return out

    def ids(self, texts: list[str]):
        """The ids of each text, one array after another."""
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            parts, owner, after = self._segments(texts[a:b])
            symbols, bounds, which, first = self._encode(parts)
            count = np.diff(bounds)[which] if len(which) else np.zeros(0, np.int64)
            total = np.append(0, np.cumsum(count)).astype(np.int64)
            flat = symbols[np.arange(total[-1]) - np.repeat(total[:-1] - bounds[which], count)] if len(which) else symbols
            follow = dict(after)
            held: list[list[np.ndarray]] = [[] for _ in range(b - a)]
            for p, o in enumerate(owner.tolist()):
                held[o].append(flat[total[first[p]] : total[first[p + 1]]])
                if p in follow:
                    held[o].append(np.array([follow[p]], np.int32))
            for x in held:
                yield x[0] if len(x) == 1 else np.concatenate(x)


@lru_cache(4)
def loaded(path: str) -> ByteBpe:
    """One copy of a vocabulary for each worker."""
    return ByteBpe(path)
