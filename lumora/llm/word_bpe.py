"""Byte-pair encoding of many words at once, in numpy.

For vocabularies with an end-of-word suffix, whose words are merged on their own: all words of one length are rows of a
matrix of symbols; each step merges, in every row that has one, the pair of lowest rank (the leftmost of equal ones), as the
sequential algorithm does, and rows without a pair leave.
"""

from __future__ import annotations

import json

import numpy as np

_NEVER = np.int32(2**31 - 1)


class PairTable:
    """Rank and merged symbol of pairs of symbols below 2**16, by direct address; pairs that clash go on to the next table."""

    BITS = 18

    def __init__(self, pairs: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        rng, self.tables = np.random.default_rng(5), []
        while len(pairs):
            odd = np.uint64(int(rng.integers(0, 2**63)) | 1)
            slot = self._slot(pairs, odd)
            _, first = np.unique(slot, return_index=True)
            keys, ranks, out = np.full(1 << self.BITS, 2**32 - 1, np.uint32), np.full(1 << self.BITS, _NEVER), np.zeros(1 << self.BITS, np.uint16)
            keys[slot[first]], ranks[slot[first]], out[slot[first]] = pairs[first], rank[first], merged[first]
            self.tables.append((odd, keys, ranks, out))
            rest = np.ones(len(pairs), bool)
            rest[first] = False
            pairs, rank, merged = pairs[rest], rank[rest], merged[rest]

    def _slot(self, pairs: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((pairs.astype(np.uint64) * odd) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NEVER: none) and merged symbol."""
        pairs = (left.astype(np.uint32) << np.uint32(16)) | right
        rank, merged = np.full(pairs.shape, _NEVER), np.zeros(pairs.shape, np.uint16)
        for odd, keys, ranks, out in self.tables:
            slot = self._slot(pairs, odd)
            hit = keys[slot] == pairs
            np.copyto(rank, ranks[slot], where=hit)
            np.copyto(merged, out[slot], where=hit)
        return rank, merged


class WordBpe:
    """Encodes whole words (UTF-8 bytes, none empty) by a tokenizer file's merges; ``usable`` says if the file allows it."""

    def __init__(self, path: str, alphabet: dict[int, str]):
        with open(path, encoding="utf-8") as f:
            model = json.load(f).get("model", {})
        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab", {})
        self.usable = bool(model.get("type") == "BPE" and suffix and isinstance(vocab, dict) and max(vocab.values(), default=0) < 2**16 and not model.get("dropout") and not model.get("ignore_merges") and len(alphabet) == 256)
        self.usable = self.usable and all(alphabet[b] in vocab and alphabet[b] + suffix in vocab for b in range(256))
        if not self.usable:
            return
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array([vocab[x] for x in xs], np.uint32) for xs in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.table = PairTable((left << np.uint32(16)) | right, np.arange(len(merges), dtype=np.int32), merged.astype(np.uint16))
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.uint16)
        self.last = np.array([vocab[alphabet[b] + suffix] for b in range(256)], np.uint16)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 16-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = int(size[order[a]])
            # some hundred thousand symbols at a time
            step = max(1, 400_000 // n)
            for c in range(a, b, step):
                own = order[c : min(c + step, b)]
                raw = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(-1, n)
                symbols = self.inner[raw]
                symbols[:, -1] = self.last[raw[:, -1]]
                self._merge(symbols, own, out)
        return out

    def _merge(self, symbols: np.ndarray, own: np.ndarray, out: list[bytes]) -> None:
        rank, merged = self.table.find(symbols[:, :-1], symbols[:, 1:])
        while len(own):
            n = symbols.shape[1]
            at = rank.argmin(1) if n > 1 else np.zeros(len(own), np.int64)
            rows = np.arange(len(own))
            going = rank[rows, at] != _NEVER if n > 1 else np.zeros(len(own), bool)
            if not going.all():
                done, width = symbols[~going].astype("<u2", copy=False).tobytes(), 2 * n
                for k, i in enumerate(own[~going].tolist()):
                    out[i] = done[k * width : (k + 1) * width]
                symbols, rank, merged, own, at = symbols[going], rank[going], merged[going], own[going], at[going]
                rows = np.arange(len(own))
                if not len(own):
                    return
            made = merged[rows, at]
            # the row without the merged pair's right symbol; pairs likewise, and those at the merged symbol anew
            keep = np.arange(n - 1)
            symbols = np.take_along_axis(symbols, keep + (keep > at[:, None]), 1)
            symbols[rows, at] = made
            keep = keep[:-1] + (keep[:-1] >= at[:, None])
            rank, merged = np.take_along_axis(rank, keep, 1), np.take_along_axis(merged, keep, 1)
            for side in (at - 1, at):
                on = np.flatnonzero((side >= 0) & (side < n - 2))
                rank[on, side[on]], merged[on, side[on]] = self.table.find(symbols[on, side[on]], symbols[on, side[on] + 1])
