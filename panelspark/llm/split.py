"""Splitting of oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import SPREAD_BYTES, any_long, encode, one_per_document
from .vocabulary import FOLDER, VOCABULARY, Vocabulary, vocabulary

LIMIT, OVERLAP = 512, 64

# Strengths of cuts, from a blank line down to the inside of a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, MARK, PLAIN, NONE = 6, 5, 4, 3, 2, 1, 0, -1
# Full-width marks in UTF-8 that end a sentence or a clause.
_WIDE_STOPS = ("。", "！", "？")
_WIDE_COMMAS = ("，", "；", "：", "、")


def strengths(data: bytes) -> np.ndarray:
    """Of each byte position from 0 to the end, how natural a cut before it is."""
    n = len(data)
    b = np.concatenate([np.frombuffer(data, np.uint8), [0, 0, 0]])
    s = np.full(n + 1, PLAIN, np.int8)
    if not n:
        return s
    space = np.isin(b, (9, 10, 11, 12, 13, 32))
    before, here = slice(0, n), slice(1, n + 1)  # of position i: byte i - 1, byte i

    def raise_to(at: np.ndarray, level: int) -> None:
        s[1:][at] = np.maximum(s[1:][at], level)

    raise_to(np.isin(b[before], list(b"_-/|;,:.=)]}>")), MARK)
    raise_to(space[here] | space[before], WORD)
    raise_to(np.isin(b[before], list(b",;:")) & space[here], CLAUSE)
    raise_to(np.isin(b[before], list(b".!?")) & space[here], SENTENCE)
    for marks, level in ((_WIDE_COMMAS, CLAUSE), (_WIDE_STOPS, SENTENCE)):
        for m in marks:
            x, y, z = m.encode()
            hit = (b[: n - 2] == x) & (b[1 : n - 1] == y) & (b[2:n] == z) if n >= 3 else np.zeros(0, bool)
            s[3:][: len(hit)][hit] = np.maximum(s[3:][: len(hit)][hit], level)
    line = (b[before] == 10) & (b[here] != 10)
    raise_to(line, LINE)
    blank = line.copy()
    blank[1:] &= b[: n - 1] == 10
    blank[0] = False
    raise_to(blank, PARAGRAPH)
    s[: n + 1][(b[: n + 1] & 0xC0) == 0x80] = NONE
    s[n] = PARAGRAPH
    return s


class StrongestCut:
    """Sparse table over strengths: the strongest position of any range in two looks, the rightmost of equals."""

    def __init__(self, s: np.ndarray, widest: int):
        self.s = s
        self.levels = [np.arange(len(s), dtype=np.int32)]
        step = 1
        while 2 * step <= min(widest, len(s)):
            a = self.levels[-1]
            left, right = a[: len(a) - step], a[step:]
            self.levels.append(np.where(s[right] >= s[left], right, left))
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        """Of lo to hi, both included."""
        k = min((hi - lo + 1).bit_length() - 1, len(self.levels) - 1)
        span = 1 << k
        best = int(self.levels[k][lo])
        for at in [*range(lo + span, hi - span + 2, span), hi - span + 1]:
            other = int(self.levels[k][at])
            if self.s[other] > self.s[best] or (self.s[other] == self.s[best] and other > best):
                best = other
        return best


class Boundaries:
    """The strongest cut of any range of a long text: a StrongestCut of one segment at a time, so that memory is bounded."""

    SEGMENT = 1 << 16

    def __init__(self, s: np.ndarray, widest: int):
        self.s, self.widest, self.base, self.table = s, widest, 0, None

    def best(self, lo: int, hi: int) -> int:
        if self.table is None or lo < self.base or hi >= self.base + len(self.table.s):
            self.base = lo
            self.table = StrongestCut(self.s[lo : max(hi + 1, lo + self.SEGMENT)], self.widest)
        return self.base + self.table.best(lo - self.base, hi - self.base)


def pieces(text: str | None, v: Vocabulary, limit: int = LIMIT, overlap: int = OVERLAP, ids: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(first byte, end byte, tokens, tokens repeated) of the pieces of a text; none if it has at most `limit` tokens.

    Each piece ends at the strongest cut of its permissible lengths (from half the limit on, rightmost of equals; from
    the previous end on if those hold no natural cut) and the next begins at the strongest cut in the outer half of
    the overlap. Tokens are those of the piece's text itself; if they exceed the limit, the window is shortened.
    ids: those of the text, if known.
    """
    ids = v.encode_by_fragments(text) if ids is None else ids
    n = len(ids)
    if n <= limit:
        return []
    data = text.encode("utf-8", "surrogatepass")
    at = np.concatenate([[0], np.cumsum(v.n_bytes[ids])])
    s = strengths(data)[at]
    table = Boundaries(s, limit)
    sure = np.searchsorted(at, np.concatenate([[0], v.cuts(data), [len(data)]]))  # token numbers of the certain cuts

    def size(a: int, b: int) -> int:
        """Tokens of the text of tokens a to b by itself: between certain cuts those of the whole text, at its ends counted anew."""
        x, y = int(np.searchsorted(sure, a)), int(np.searchsorted(sure, b, "right")) - 1
        count = lambda i, j: len(v.encode(data[at[i] : at[j]].decode("utf-8", "surrogatepass"))) if j > i else 0
        if x > y:
            return count(a, b)
        c, d = int(sure[x]), int(sure[y])
        return count(a, c) + d - c + count(d, b)

    out, start, end, repeated = [], 0, 0, 0
    while end < n:
        longest = limit
        while True:
            hi = min(start + longest, n)
            lo = min(max(start + longest // 2, end + 1), hi)
            cut = n if hi == n else table.best(lo, hi)
            if s[cut] <= PLAIN and lo > end + 1:
                cut = table.best(end + 1, hi)
            tokens = size(start, cut)
            if tokens <= limit or cut <= end + 1:
                break
            longest = min(longest, cut - start) - max(1, tokens - limit)
        out.append((int(at[start]), int(at[cut]), tokens, repeated))
        end = cut
        if end >= n:
            break
        lo = max(start + 1, end - overlap)
        start = table.best(lo, max(lo, end - overlap // 2))
        while start < end and (s[start] < PLAIN or size(start, end) > overlap):
            start += 1
        repeated = size(start, end) if start < end else 0
    return out


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, name: str = VOCABULARY, folder: str = FOLDER, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """(key, piece_no, n_tokens, repeated, text): the pieces, from 0, of every text of more than `limit` tokens.

    A piece has at most `limit` tokens, of which the first `repeated` (at most `overlap`) are the end of the piece
    before. Shorter, empty and null texts give nothing. Rows with a null key are left out; repeated keys count once;
    an empty table gives an empty result. A text of at most `limit` bytes cannot have more tokens and is not read by
    the tokenizer. Texts from spread_bytes on are encoded in fragments over several tasks; one task then takes their
    pieces from the ids, encoding no more than the pieces' ends.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") > limit)
    base = one_per_document(base, "key")
    kind = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            for i in range(b.num_rows):
                whole = b.column("text")[i].as_py()
                ids = b.column("ids")[i].values.to_numpy(zero_copy_only=False) if "ids" in b.schema.names else None
                found = pieces(whole, v, limit, overlap, ids)
                data = whole.encode("utf-8", "surrogatepass") if found else b""
                for j in range(0, len(found), 256):
                    some = found[j : j + 256]
                    cols = [b.column("key").take(pa.array([i] * len(some))), pa.array(range(j, j + len(some)), pa.int32()), pa.array([p[2] for p in some], pa.int32()), pa.array([p[3] for p in some], pa.int32()), pa.array([data[p[0] : p[1]].decode("utf-8", "surrogatepass") for p in some], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "piece_no", "n_tokens", "repeated", "text"])

    schema = f"key {kind}, piece_no int, n_tokens int, repeated int, text string"
    if not any_long(base, "text", spread_bytes):
        return base.mapInArrow(run, schema).withColumnRenamed("key", key)
    long = base.filter(F.octet_length("text") >= spread_bytes)
    known = long.join(encode(long, "key", "text", name, folder, spread_bytes=spread_bytes), "key")
    out = base.filter(F.octet_length("text") < spread_bytes).mapInArrow(run, schema).unionByName(known.mapInArrow(run, schema))
    return out.withColumnRenamed("key", key)
