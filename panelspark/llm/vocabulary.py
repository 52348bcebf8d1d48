"""A byte-level BPE vocabulary from its rank file, and the certain cuts it implies."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Where the public tokenizers' files are.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Bytes a fragment has at least: with 1 a text is cut at every certain cut.
FRAGMENT_BYTES = 1
#: Fragments whose ids a process remembers, and the bytes up to which one is remembered.
REMEMBERED, SHORT = 200_000, 32
#: Bytes of a text in which certain cuts are looked for at a time.
BLOCK = 1 << 20

# Fixed value: the published pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space among the ASCII characters; those of them that only some definitions count; the first two
# bytes, in UTF-8, of all other white space (and of other characters, which then are no places for a cut either).
BLANKS = (9, 10, 11, 12, 13, 32)
DOUBTFUL = (28, 29, 30, 31)
WIDE_BLANKS = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


class Vocabulary:
    """Encoder of one rank file.

    A byte pair that occurs inside no token can never be merged, so the encoding of a text has a boundary between the
    two bytes wherever they meet. If a cut there also leaves the pattern's splitting of both sides as it was, the two
    sides can be encoded apart and the ids put one after the other: such a place is a certain cut.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.never = np.ones(65536, bool)
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)
            if len(token) > 1:
                t = np.frombuffer(token, np.uint8).astype(np.int64)
                self.never[t[:-1] * 256 + t[1:]] = False
        self.remembered: dict[bytes, list[int]] = {}
        self._left, self._right = np.ones(256, bool), np.ones(256, bool)
        self._left[[*BLANKS, *DOUBTFUL]] = False
        self._right[[*DOUBTFUL, ord("'"), *range(0x80, 0xC0)]] = False  # and not within a character
        self._blank, self._wide = np.zeros(256, bool), np.zeros(65536, bool)
        self._blank[[*BLANKS]] = True
        self._wide[[a * 256 + b for a, b in WIDE_BLANKS]] = True

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text taken whole; strings of special tokens are ordinary text."""
        return np.asarray(self.encoding.encode_ordinary(text), np.int32)

    def cuts(self, data: bytes) -> np.ndarray:
        """Every certain cut of a text, as byte positions, in order.

        The pair of bytes occurs in no token, and the pattern's splits stay as they are: the character on the left is
        no white space (a run of it looks ahead); white space on the right always begins a new split; anything else
        goes on in, or begins, a split of its class, unless an apostrophe is involved.
        """
        whole = np.frombuffer(data, np.uint8)
        found = [self._cuts(whole[max(at - 3, 0) : at + BLOCK + 2], min(at, 3)) + max(at - 3, 0) for at in range(0, len(data), BLOCK)]
        return found[0] if len(found) == 1 else np.concatenate([np.empty(0, np.int64), *found])

    def _cuts(self, b: np.ndarray, begin: int) -> np.ndarray:
        """Of a block's own positions, from `begin` on; it comes with the three bytes before and the two after it."""
        pair = np.left_shift(b[:-1].astype(np.uint16), 8) | b[1:]
        k = np.flatnonzero(self.never[pair]) + 1
        k = k[(k >= begin) & (k < begin + BLOCK)]
        k = k[self._left[b[k - 1]] & self._right[b[k]]]
        k = k[(b[k - 1] != ord("'")) | self._blank[b[k]]]
        wide = np.zeros(len(b) + 4, bool)  # wide[i + 3]: of the bytes i and i + 1
        wide[3 : 3 + len(pair)] = self._wide[pair]
        return k[~(wide[k + 3] | wide[k + 1] | wide[k])]

    def fragments(self, text: str, size: int = FRAGMENT_BYTES) -> list[str]:
        """The text cut at certain cuts into fragments of at least `size` bytes (the last one may be shorter)."""
        data = text.encode("utf-8", "surrogatepass")
        return [f.decode("utf-8", "surrogatepass") for f in self._fragments(data, size)]

    def _fragments(self, data: bytes, size: int) -> list[bytes]:
        cuts = self.cuts(data)
        if size > 1:
            kept, at = [], 0
            while (i := int(np.searchsorted(cuts, at + size))) < len(cuts):
                at = int(cuts[i])
                kept.append(at)
            cuts = np.asarray(kept, np.int64)
        ends = [*cuts.tolist(), len(data)]
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode_by_fragments(self, text: str | None, size: int = FRAGMENT_BYTES) -> np.ndarray:
        """The same ids as encode(), one fragment at a time; empty for an empty or null text."""
        if not text:
            return np.empty(0, np.int32)
        ids, known = [], self.remembered
        for f in self._fragments(text.encode("utf-8", "surrogatepass"), size):
            of_f = known.get(f)
            if of_f is None:
                of_f = self.encoding.encode_ordinary(f.decode("utf-8", "surrogatepass"))
                if len(f) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[f] = of_f
            ids += of_f
        return np.asarray(ids, np.int32)


@lru_cache(maxsize=4)
def vocabulary(name: str = VOCABULARY, folder: str = FOLDER) -> Vocabulary:
    """The vocabulary, loaded once per process."""
    return Vocabulary(os.path.join(folder, f"{name}.tiktoken"))
