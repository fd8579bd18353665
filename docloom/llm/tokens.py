"""Problem 6: the corpus as token ids of a public byte-level BPE tokenizer.

Every Arrow batch of a partition is encoded at once, without a Python loop over texts:

1. the code points of all texts lie in one array; token pieces ("words") are cut where the
   character class changes, as the tokenizer's pattern asks;
2. equal words are encoded once (a hash groups them, a comparison of all characters
   confirms the groups), and words met before in the partition come from a table;
3. the new words' bytes get a pair occurrence index: each mergeable pair of neighbours with
   all its positions. Active ranks are applied in ascending order; a rank merges all its
   positions in one step and enters the pairs that this makes into the index. A merge can
   only make pairs of a higher rank, so one pass is exact.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: The vocabulary file; a parameter, as the files belong to the environment.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Code points encoded at a time, and words kept from one batch of a partition to the next;
#: both bound memory and change no result.
BLOCK = 3_000_000
KEPT_WORDS = 400_000

_SPACE, _LETTER, _NUMBER, _OTHER, _EDGE = range(5)


@functools.cache
def _classes() -> np.ndarray:
    """The pattern's class of each code point: white space, letter, number, other."""
    out = np.full(sys.maxunicode + 1, _OTHER, np.int8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = _LETTER
        elif kind == "N":
            out[cp] = _NUMBER
    # fixed values: the code points of Unicode's property White_Space
    out[[9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]] = _SPACE
    return out


class Merges:
    """The merge table of a byte-level BPE as sorted arrays: pair key -> rank, new token."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        printed = _printed_bytes()
        self.of_byte = np.array([vocab[printed[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = (left << 32) | right
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.left, self.right = left.tolist(), right.tolist()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], -1)


def _printed_bytes() -> list[str]:
    """Byte-level BPE writes bytes as printable characters; the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def apply_merges(symbols: np.ndarray, word: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left after all merges inside words, and the word of each.

    ``symbols`` are byte tokens, ``word`` the (ascending) word number of each.
    """
    n = len(symbols)
    sym = symbols.copy()
    if n < 2:
        return sym, word
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[np.flatnonzero(np.append(word[1:] != word[:-1], True))] = n
    prv[np.flatnonzero(np.append(True, word[1:] != word[:-1]))] = -1
    nxt, prv = np.append(nxt, n), np.append(prv, -1)  # position n is the void
    sym = np.append(sym, np.int32(-1)).astype(np.int32)
    alive = np.ones(n + 1, bool)

    # the index: for each active rank, blocks of the positions of its pair's left symbol
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[nxt[at] < n]
        rank = table.ranks(sym[at], sym[nxt[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, block in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            if r in lists:
                lists[r].append(block)
            else:
                lists[r] = [block]
                heapq.heappush(active, r)

    enter(np.arange(n, dtype=np.int32))
    while active:
        r = heapq.heappop(active)
        blocks = lists.pop(r)
        a, b = table.left[r], table.right[r]
        at = blocks[0] if len(blocks) == 1 else np.unique(np.concatenate(blocks))
        at = at[alive[at] & (sym[at] == a)]
        at = at[sym[nxt[at]] == b]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # in a run of equal symbols every other pair merges, from the left
            at = np.unique(at)
            joined = np.append(False, nxt[at[:-1]] == at[1:])
            first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = table.made[r]
        alive[gone] = False
        nxt[at] = after
        inside = after < n
        prv[after[inside]] = at[inside]
        before = prv[at]
        before = before[before >= 0]
        enter(np.concatenate([at, before]) if len(before) else at)
    keep = alive[:n]
    return sym[:n][keep], word[keep]


def word_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the words of the pattern begin, by comparing the classes of neighbours.

    A word is a run of letters, of numbers or of other characters with at most one space
    before it, a run of white space without its last character if a word follows, or an
    apostrophe with one of the endings s t re ve m ll d.
    """
    n = len(codes)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[text_starts[text_starts < n]] = True
    edge[n] = True
    new_run = edge[:n].copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    start = new_run.copy()
    # white space: its last character stands alone or, a plain space, goes to the word after
    space = kind == _SPACE
    last = space & np.append(new_run[1:], True)
    followed = last & ~edge[1:]
    start |= followed
    plain = followed & (codes == 32)
    takes = np.flatnonzero(plain) + 1
    start[takes] = False
    # apostrophes that begin a word take a fixed ending
    apo = np.flatnonzero((codes == 39) & start)
    if len(apo):
        room = np.append(codes, [0, 0])
        text_end = np.append(text_starts, n)
        end = text_end[np.searchsorted(text_end, apo, side="right")]
        c1 = np.where(apo + 1 < end, room[apo + 1], 0)
        c2 = np.where(apo + 2 < end, room[np.minimum(apo + 2, n)], 0)
        one = np.isin(c1, [115, 116, 109, 100])
        two = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)
        for at, size in ((apo[one], 2), (apo[two & ~one], 3)):
            start[at + 1] = False
            rest = at + size
            inside = rest < n
            rest = rest[inside]
            start[rest] |= kind[rest] == kind[rest - 1]  # the rest of the run of letters
    return np.flatnonzero(start)


class Encoder:
    """Encodes blocks of texts; keeps the words of earlier blocks."""

    def __init__(self, path: str = TOKENIZER):
        self.table = merges(path)
        rng = np.random.default_rng(20240)
        self.mix = rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.uint32)
        self.char_begin, self.char_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end). Null and empty texts have no ids."""
        joined = "".join(t for t in texts if t)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = word_starts(codes, ends - sizes)
        length = np.diff(np.append(starts, len(codes)))
        hashed = self._hash(codes, starts, length)
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        rep_start, rep_size, rep_hash = starts[first], length[first], hashed[first]
        if not _same(codes, starts, length, codes, rep_start[which], rep_size[which]):
            return self._slowly(codes, starts, length, ends)
        known = np.searchsorted(self.known, rep_hash)
        known[known == len(self.known)] = 0
        met = self.known[known] == rep_hash if len(self.known) else np.zeros(len(first), bool)
        if met.any() and not _same(codes, rep_start[met], rep_size[met], self.chars, self.char_begin[known[met]], self.char_size[known[met]]):
            met[:] = False
        new = np.flatnonzero(~met)
        new_ids, new_size = self._words(codes, rep_start[new], rep_size[new])
        # the ids of each distinct word: in the table of earlier words or among the new ones
        pool = np.concatenate([self.ids, new_ids])
        begin, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        size[new] = new_size
        begin[new] = len(self.ids) + np.cumsum(new_size) - new_size
        begin[met], size[met] = self.begin[known[met]], self.size[known[met]]
        out = _gather(pool, begin[which], size[which])
        upto = np.append(0, np.cumsum(size[which]))
        text_end = upto[np.searchsorted(starts, ends)]
        self._keep(codes, rep_start[new], rep_size[new], rep_hash[new], new_ids, new_size)
        return out, text_end

    def _hash(self, codes, starts, length):
        within = np.arange(len(codes), dtype=np.int32) - np.repeat(starts, length).astype(np.int32)
        v = (codes.astype(np.uint64) + np.uint64(1)) * self.mix[within & 511]
        v ^= v >> np.uint64(29)
        if len(length) and length.max() > 512:
            v += (within >> 9).astype(np.uint64) * v
        h = np.add.reduceat(v, starts) + length.astype(np.uint64) * self.mix[7]
        return h ^ (h >> np.uint64(31))

    def _words(self, codes, start, size):
        """Ids of the given words one after the other, and how many each has."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        chars = _gather(codes, start, size)
        of_char = np.repeat(np.arange(len(start), dtype=np.int32), size)
        width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        ids, of = apply_merges(self.table.of_byte[raw], np.repeat(of_char, width), self.table)
        return ids, np.bincount(of, minlength=len(start)).astype(np.int64)

    def _keep(self, codes, start, size, hashed, ids, id_size):
        if len(self.known) + len(start) > KEPT_WORDS or not len(start):
            return
        chars = _gather(codes, start, size)
        h = np.concatenate([self.known, hashed])
        order = np.argsort(h, kind="stable")
        self.known = h[order]
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(id_size) - id_size])[order]
        self.size = np.concatenate([self.size, id_size])[order]
        self.char_begin = np.concatenate([self.char_begin, len(self.chars) + np.cumsum(size) - size])[order]
        self.char_size = np.concatenate([self.char_size, size])[order]
        self.ids, self.chars = np.concatenate([self.ids, ids]), np.concatenate([self.chars, chars])

    def _slowly(self, codes, starts, length, ends):
        """Two different words with one hash: encode every word as it stands."""
        ids, size = self._words(codes, starts, length)
        return ids, np.append(0, np.cumsum(size))[np.searchsorted(starts, ends)]


def _gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return source[np.arange(total) + shift]


def _same(a, a_start, a_size, b, b_start, b_size) -> bool:
    return bool((a_size == b_size).all()) and bool((_gather(a, a_start, a_size) == _gather(b, b_start, b_size)).all())


def _blocks(texts: list[str | None]):
    """Consecutive texts of about BLOCK code points together; a longer text stands alone."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > BLOCK:
            yield texts[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield texts[begin:]


def encode(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids): the ids of each row's text without special tokens.

    Null and empty texts give an empty array; strings that look like special tokens are
    ordinary text; repeated rows and keys stay rows of their own; other columns are not
    read. No shuffle: each partition is encoded where it is read.
    """
    key_type = df.schema[key].dataType
    data = df.select(F.col(key), F.col(text))

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), 0
            for part in _blocks(texts):
                ids, ends = encoder.encode(part)
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[key, "ids"])
                done += len(part)

    return data.mapInArrow(run, f"`{key}` {key_type.simpleString()}, ids array<int>")


def count(df: DataFrame, text: str, out: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without its text, with the number of the text's tokens as ``out`` (0 for null)."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, StructField(out, LongType())])
    data = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text))

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            sizes = [np.diff(np.append(0, encoder.encode(part)[1])) for part in _blocks(batch.column(len(kept)).to_pylist())]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int64())], names=[*kept, out])

    return data.mapInArrow(run, schema)
