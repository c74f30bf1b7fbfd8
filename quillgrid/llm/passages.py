"""Substring deduplication by paragraph MinHash banding.

Words are compared without case, punctuation and line breaks. A text's words have breaks that are set by
content: where the hash of two neighbouring words is the least within `REACH` places on either side, and
at both ends of a stretch that repeats a word or a short line. A paragraph goes from a break to the first
break that is at least `LEAST` words further, so paragraphs overlap and a passage that stands in two texts
holds the same paragraphs in both, wherever it stands and however its lines are broken (all passages of 50
words or more in the tests). A text that is shorter is one paragraph.

1. Paragraphs get MinHashes of their 5-word shingles in `BANDS` bands of `ROWS` rows: at a similarity of
   0.8 two collide in some band with probability 1 - (1 - 0.8**3)**4 = 0.943, at 0.85 with 0.978. Band values are brought
   together in slices as sorted arrays; a text goes on if one of its values occurs again. Values that
   occur again inside a task's own texts are sent once, so a frequent line doesn't gather in one slice.
2. Colliding paragraphs are verified by exact Jaccard similarity of their words' shingles. Equal ones are
   grouped by their bytes before. A band with very many paragraphs is cut by a prefix join: only those are
   compared that share one of their rarest shingles.
3. Connected components of verified pairs are the classes. The first occurrence of a class stays, by key
   and place, the others are removals.
4. Paragraphs found next to each other, with at most `GAP` other words between them, are put together, and
   these longer paragraphs go through 2 and 3 as well (in 6 bands): so a passage with a few changed words
   is removed as a whole, changed words included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, written
from .components import connected_components
from .decontamination import FOLD

REACH = 4
LEAST = 16
LONGEST = 64
#: Words of the pieces into which a stretch of repeated words is cut.
STRETCH = 32
GAP = 24
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 4, 3
LONG_BANDS = 6
SLICE_BYTES = 16 << 20
FLUSH = 1 << 22
GROUP = 512
#: Counters of shingles (8 bytes each, sent to every task) that set the order of prefixes.
SKETCH, SKETCH_PARTS = 1 << 17, 16
GATHER = 1 << 17
TAG_BITS = 40

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 63, LONG_BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, LONG_BANDS * ROWS, dtype=np.uint64)
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


class Layout:
    """Texts side by side, as word hashes in one array, cut into paragraphs.

    Texts are kept apart by REACH empty places, so that no break depends on a neighbouring text. starts and
    ends are places of paragraphs, first and last those of their texts; owner is their text.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.at = np.r_[0, np.cumsum(sizes)]
        self.buffer = b" ".join([*texts, b""])
        raw = np.frombuffer(self.buffer, np.uint8)
        edges = np.flatnonzero(np.diff(np.r_[False, raw != 32, False]))
        self.word_starts, self.word_ends = edges[::2], edges[1::2]
        sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw)))]
        words = (sums[self.word_ends] - sums[self.word_starts]) * _inverses(len(raw))[self.word_starts]
        words = mixed(mixed(words) + (self.word_ends - self.word_starts).astype(np.uint64))
        self.sizes = np.diff(np.searchsorted(self.word_starts, self.at))
        self.begin = np.r_[0, np.cumsum(self.sizes + REACH)]
        self.hashes = np.zeros(self.begin[-1], np.uint64)
        self.hashes[np.arange(len(words)) + REACH * np.repeat(np.arange(len(texts)), self.sizes)] = words

    def _take(self, starts: np.ndarray, ends: np.ndarray | None = None) -> None:
        self.starts = starts
        self.owner = np.searchsorted(self.begin, starts, "right") - 1
        self.first, self.last = self.begin[self.owner], self.begin[self.owner] + self.sizes[self.owner]
        self.ends = self.last if ends is None else ends

    def whole(self) -> Layout:
        """Each text as one paragraph."""
        self._take(self.begin[:-1])
        self.owner, self.last = np.arange(len(self.sizes)), self.begin[:-1] + self.sizes
        self.ends = self.last
        return self

    def paragraphs(self, least: int = LEAST) -> Layout:
        """From each break to the first one that is `least` words further, and from the last that leaves as many to the text's end; texts of SHINGLE words or more that are shorter as a whole."""
        self._take(self.breaks())
        marks = np.unique(np.r_[self.starts, self.last])
        at = np.searchsorted(marks, self.starts + least)
        ends = np.r_[marks, np.int64(1) << 62][at]
        short = (self.starts == self.first) & (ends > self.last) & (self.last - self.starts >= SHINGLE)
        ends = np.where(short, self.last, ends)
        room = self.last - self.starts >= least
        final = room & ~np.r_[room[1:] & (self.owner[1:] == self.owner[:-1]), False] & (ends != self.last)
        starts, ends = np.r_[self.starts, self.starts[final]], np.r_[ends, self.last[final]]
        real = np.flatnonzero(ends <= np.r_[self.last, self.last[final]])
        order = real[np.lexsort((ends[real], starts[real]))]
        self._take(starts[order], ends[order])
        return self

    def breaks(self) -> np.ndarray:
        """Places of breaks, the beginnings of texts included."""
        h, heads = self.hashes, self.begin[np.flatnonzero(self.sizes)]
        if len(h) < 2:
            return heads
        real = np.zeros(len(h) + 1, np.int64)
        np.add.at(real, self.begin[:-1], 1)
        np.add.at(real, self.begin[:-1] + self.sizes, -1)
        real = np.cumsum(real)[:-1] > 0
        pair = mixed(h[:-1] * _PRIME + h[1:])
        pair[~(real[:-1] & real[1:])] = _MAX
        least, again = pair != _MAX, np.zeros(len(h), bool)
        for k in range(1, min(REACH, len(pair) - 1) + 1):
            least[k:] &= pair[k:] < pair[:-k]
            least[:-k] &= pair[:-k] <= pair[k:]
            again[k:] |= (h[k:] == h[:-k]) & real[k:]
        edges = np.flatnonzero(np.diff(np.r_[False, again, False]))
        low, high = edges[::2], edges[1::2]
        long = high - low >= LEAST
        cuts = np.flatnonzero(least) + 1
        if long.any():
            low, high = low[long], high[long]
            inside = np.searchsorted(low, cuts, "right") - 1
            cuts = cuts[(inside < 0) | (cuts >= high[np.maximum(inside, 0)])]
            cuts = np.concatenate([cuts, high[(high < len(h)) & real[np.minimum(high, len(h) - 1)]], *(np.arange(a, z, STRETCH) for a, z in zip(low.tolist(), high.tolist(), strict=True))])
        cuts = np.unique(np.r_[heads, cuts])
        ends = np.minimum(np.r_[cuts[1:], len(h)], (self.begin[:-1] + self.sizes)[np.searchsorted(self.begin, cuts, "right") - 1])
        far = np.flatnonzero(ends - cuts > LONGEST)
        return np.unique(np.concatenate([cuts, *(np.arange(cuts[i], ends[i], LONGEST) for i in far)]))

    def words_before(self, places: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return places - REACH * owner

    def bytes_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the chosen paragraphs in the buffer."""
        gaps = REACH * self.owner[which]
        return self.word_starts[self.starts[which] - gaps], self.word_ends[self.ends[which] - 1 - gaps]

    def _hashed(self) -> np.ndarray:
        """Hashes of the shingles that start at each place."""
        h, n = self.hashes, len(self.hashes)
        s = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            s = mixed(s * _PRIME + h[k : n - SHINGLE + 1 + k])
        return s

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, hash) of the shingles of paragraphs that don't overlap, sorted; paragraphs under SHINGLE words have none."""
        usable = np.flatnonzero(self.ends - self.starts >= SHINGLE)
        if not len(usable):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = (self.ends - self.starts - SHINGLE + 1)[usable]
        owner = np.repeat(usable, n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + self.starts[owner]
        hashes = self._hashed()[at]
        order = np.lexsort((hashes, owner))
        return owner[order], hashes[order]

    def bands(self, bands: int = BANDS) -> np.ndarray:
        """(paragraphs, bands) of band values; paragraphs under SHINGLE words have all-ones values."""
        out = np.full((len(self.starts), bands), _MAX, np.uint64)
        usable = self.ends - self.starts >= SHINGLE
        if not usable.any():
            return out
        s = self._hashed()
        # reduceat over (start, end) pairs: every second result belongs to a paragraph
        cuts = np.stack([self.starts[usable], self.ends[usable] - SHINGLE + 1], axis=1).ravel()
        for b in range(bands):
            value = np.full(len(cuts) // 2, np.uint64(b + 1))
            for r in range(ROWS):
                p = mixed(s * _MULTIPLY[b * ROWS + r] + _ADD[b * ROWS + r])
                value = mixed(value * _PRIME + np.minimum.reduceat(np.r_[p, _MAX], cuts)[::2])
            out[usable, b] = value
        return out


_GROWN: dict[int, np.ndarray] = {}


def _series(factor: int, n: int) -> np.ndarray:
    """factor ** 0 .. factor ** (n - 1), modulo 2 ** 64."""
    if len(_GROWN.get(factor, ())) < n:
        _GROWN[factor] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, GATHER) * 2, np.uint64(factor))])
    return _GROWN[factor][:n]


def _powers(n: int) -> np.ndarray:
    return _series(int(_PRIME), n)


def _inverses(n: int) -> np.ndarray:
    return _series(pow(int(_PRIME), -1, 1 << 64), n)


def shingle_set(words: list) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def similar(a: set, b: set, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity is at least `similarity`; sizes are compared first."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def prefix_lengths(size: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """How many of its rarest shingles a set is found by, and how many it looks up among sets that aren't larger."""
    held = size - math.ceil(2 * similarity / (1 + similarity) * size - 1e-9) + 1
    return held, size - math.ceil(similarity * size - 1e-9) + 1


def laid_out(texts: Iterator[bytes | None], fold: bool = True) -> Iterator[Layout]:
    """Layouts of some texts at a time; every text is in one of them, in order."""
    held, size = [], 0
    for t in texts:
        held.append((t or b"").translate(FOLD) if fold else bytes(t))
        size += len(held[-1])
        if size >= GATHER or len(held) >= GATHER // 64:
            yield Layout(held)
            held, size = [], 0
    if held:
        yield Layout(held)


def slice_bits(total_bytes: int) -> int:
    return max(0, min(20, (total_bytes // SLICE_BYTES).bit_length()))


def cut_values(values: np.ndarray, bits: int) -> np.ndarray:
    """The leading 32 + bits bits: those of the slice, and 32 inside it. Equal by chance only means a text too many is read again."""
    return values >> np.uint64(32 - bits)


def colliding_values(docs: DataFrame, bits: int) -> DataFrame:
    """tag, value: the band values of a text (columns a, b, _t; tag: low bits of a) that occur again.

    Each task sends a value once, sorted by slice, and tells by itself the texts that share one.
    """
    flush = max(FLUSH, min(1 << 24, 16 << bits))

    def packed(values: list[np.ndarray], tags: list[np.ndarray], again: set[int], part: int) -> pa.RecordBatch:
        v, t = np.concatenate(values), np.concatenate(tags)
        order = np.lexsort((t, v))
        v, t = v[order], t[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])]  # overlapping paragraphs of a text may share a value
        v, t = v[new], t[new]
        twice = np.r_[v[1:] == v[:-1], False]
        twice[1:] |= twice[:-1].copy()
        here = twice if not again else twice | np.isin(t, np.fromiter(again, np.uint64, len(again)))
        first = np.r_[True, v[1:] != v[:-1]]
        sent_v, sent_t = v[first], t[first]
        cuts = (sent_v >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1], True])
        rows = [(int(cuts[a]), _pack(sent_v[a:z], sent_t[a:z])) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        if here.any():
            rows.append((-1 - part % (1 << bits), np.r_[v[here], t[here]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_binary()).cast(pa.binary())], ["slice", "data"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, tags, again, seen, size, part = [], [], set(), set(), 0, 0
        for b in batches:
            a, other = b.column(0).to_pylist(), b.column(1).to_pylist()
            fresh = []
            for i, who in enumerate(zip(a, other, strict=True)):
                if who in seen:
                    again.add(who[0] & ((1 << TAG_BITS) - 1))
                else:
                    seen.add(who)
                    fresh.append(i)
            at = 0
            part ^= hash((a[0], other[0])) & 0x7FFFFFFF if a else 0
            for layout in laid_out(b.column(2)[i].as_buffer().to_pybytes() if b.column(2)[i].is_valid else None for i in fresh):
                v = cut_values(layout.paragraphs().bands(), bits)
                mine = np.array([a[i] & ((1 << TAG_BITS) - 1) for i in fresh[at : at + len(layout.sizes)]], np.uint64)
                at += len(layout.sizes)
                values.append(v.ravel())
                tags.append(np.repeat(mine[layout.owner], BANDS))
                size += v.size
                if size >= flush:
                    yield packed(values, tags, again, part)
                    values, tags, again, seen, size = [], [], set(), set(), 0
                    seen.update((a[i], other[i]) for i in fresh[:at])
        if size:
            yield packed(values, tags, again, part)

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            held = [np.frombuffer(d, np.uint64).reshape(2, -1) for d in part["data"]]
            values, tags = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        else:
            held = [_unpack(d) for d in part["data"]]
            rest, tags = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.argsort(rest, kind="stable")
            rest, tags = rest[order], tags[order]
            twice = np.r_[rest[1:] == rest[:-1], False]
            twice[1:] |= twice[:-1].copy()
            values, tags = rest[twice].astype(np.uint64) + (np.uint64(key[0]) << np.uint64(32)), tags[twice]
        return pd.DataFrame({"tag": tags.astype(np.int64), "value": values.astype(np.int64)})

    given = docs.select("a", "b", "_t").mapInArrow(build, "slice long, data binary")
    return given.groupBy("slice").applyInPandas(merge, "tag long, value long")


def _pack(values: np.ndarray, tags: np.ndarray) -> bytes:
    """9 bytes each: 32 bits of the value, 40 of the tag."""
    low, high = (tags & np.uint64(0xFFFFFFFF)).astype(np.uint32), (tags >> np.uint64(32)).astype(np.uint8)
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + low.tobytes() + high.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 9
    low, high = np.frombuffer(data, np.uint32, n, 4 * n), np.frombuffer(data, np.uint8, n, 8 * n)
    return np.frombuffer(data, np.uint32, n), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def colliding_paragraphs(texts: DataFrame, bits: int) -> DataFrame:
    """row, at, n (words), start, end (bytes) and words (in single spaces) of the paragraphs of `texts` (row, text, values) with one of `values`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = b.column(0).to_numpy(), 0
            for layout in laid_out(x.as_buffer().to_pybytes() for x in b.column(1)):
                values = cut_values(layout.paragraphs().bands(), bits)
                n = len(layout.sizes)
                edges = np.searchsorted(layout.owner, np.arange(n + 1))
                hit = np.zeros(len(layout.starts), bool)
                for i in range(n):
                    known = b.column(2)[at + i].values.to_numpy().astype(np.uint64)
                    hit[edges[i] : edges[i + 1]] = np.isin(values[edges[i] : edges[i + 1]], known).any(axis=1)
                which = np.flatnonzero(hit)
                low, high = layout.bytes_of(which)
                owner, base = layout.owner[which], layout.at[layout.owner[which]]
                words = [b" ".join(layout.buffer[s:e].split()) for s, e in zip(low.tolist(), high.tolist(), strict=True)]
                columns = [rows[at + owner], (layout.starts - layout.first)[which], (layout.ends - layout.starts)[which], low - base, high - base]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c.astype(np.int32)) for c in columns[1:]), pa.array(words, pa.binary())], ["row", "at", "n", "start", "end", "words"])
                at += n

    return texts.select("row", "text", "values").mapInArrow(run, "row long, at int, n int, start int, end int, words binary")


def joined_paragraphs(texts: DataFrame, found: DataFrame, gap: int = GAP) -> DataFrame:
    """Paragraphs like those of colliding_paragraphs, put together from two or more of `found` in a row with at most `gap` words between neighbours."""
    listed = found.groupBy("row").agg(F.collect_set(F.struct("at", "n", "start", "end")).alias("p")).where(F.size("p") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, text, parts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text, chains = text.as_buffer().to_pybytes(), []
                for p in sorted(parts, key=lambda p: (p["at"], p["n"])):
                    if chains and p["at"] <= chains[-1][1] + gap:
                        c = chains[-1]
                        c[1], c[3], c[4] = max(c[1], p["at"] + p["n"]), max(c[3], p["end"]), c[4] + 1
                    else:
                        chains.append([p["at"], p["at"] + p["n"], p["start"], p["end"], 1])
                out += [(row, at, upto - at, start, end, b" ".join(text[start:end].translate(FOLD).split())) for at, upto, start, end, k in chains if k > 1]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "at", "n", "start", "end", "words"])

    return texts.join(listed, "row").select("row", "text", "p").mapInArrow(run, "row long, at int, n int, start int, end int, words binary")


def verified_links(texts: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, bands: int = BANDS) -> DataFrame:
    """Distinct paragraphs (id, words) -> edges a, b whose components are those of all similar colliding pairs.

    Paragraphs of band values with more than `group` are compared by a prefix join instead: in an order of
    all shingles a paragraph is found by some of its first and looks up some more, and smaller sets are
    found by larger ones, which no similar pair escapes whatever the order. The order is that of a sketch of
    `SKETCH` counters, rare shingles first, so that frequent lines don't bring together what isn't similar.
    A shingle that still has more than `group` paragraphs is cut into blocks, and each pair of blocks is
    compared in its own task.
    """

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = np.concatenate([np.zeros((0, bands), np.uint64), *(layout.whole().bands(bands) for layout in laid_out(b["words"], fold=False))])
            rows = pd.DataFrame({"band": values.view(np.int64).ravel(), "id": np.repeat(b["id"].to_numpy(), bands)})
            yield rows[rows["band"] != -1].drop_duplicates()

    def counted_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            for layout in laid_out(b["words"], fold=False):
                counts += np.bincount((layout.whole().shingles()[1] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        for k, part in enumerate(np.split(counts, SKETCH_PARTS)):
            if part.any():
                yield pd.DataFrame({"part": [k], "counts": [part.tobytes()]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in part["counts"]], axis=0)
        return pd.DataFrame({"part": part["part"][:1], "counts": [total.tobytes()]})

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, ids = 0, b["id"].to_numpy()
            for layout in laid_out(b["words"], fold=False):
                owner, token = layout.whole().shingles()
                keep = np.r_[True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])][: len(owner)]
                owner, token = owner[keep], token[keep]
                order = np.lexsort((token, often.value[(token % np.uint64(SKETCH)).astype(np.int64)], owner))
                owner, token = owner[order], token[order]
                size = np.bincount(owner, minlength=len(layout.sizes))
                rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
                lengths = np.array([prefix_lengths(int(n), similarity) for n in size]).reshape(-1, 2)
                mine = rank < lengths[owner, 1]
                owner, token, rank = owner[mine], token[mine], rank[mine]
                yield pd.DataFrame({"cell": token.view(np.int64), "id": ids[at : at + len(layout.sizes)][owner], "held": rank < lengths[owner, 0]})
                at += len(layout.sizes)

    def verify(rows: list[tuple[int, int, bool, bytes]], own: bool) -> Iterator[tuple[int, int]]:
        ids, blocks, held, texts = zip(*rows, strict=True)
        sets = [shingle_set(bytes(t).split()) for t in texts]
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k, x in enumerate(order):
            least = similarity * len(sets[x]) - 1e-9
            for y in reversed(order[:k]):
                if len(sets[y]) < least:
                    break
                if held[y] and (own or blocks[x] != blocks[y]) and find(x) != find(y) and similar(sets[x], sets[y], similarity):
                    root[find(x)] = find(y)
        return ((ids[x], ids[find(x)]) for x in range(len(ids)) if find(x) != x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, edges = None, [], []
        for b in batches:
            for cell, i, j, *row in zip(b["cell"], b["i"], b["j"], b["id"], b["block"], b["held"], b["words"], strict=True):
                if (cell, i, j) != at:
                    if len(held) > 1:
                        edges += verify(held, at[1] == at[2])
                    at, held = (cell, i, j), []
                held.append(row)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
            edges = []
        if len(held) > 1:
            yield pd.DataFrame(list(verify(held, at[1] == at[2])), columns=["a", "b"], dtype="int64")

    rows = durable(texts.select("id", "words").mapInPandas(banded, "band long, id long"))
    counted = rows.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = durable(rows.join(counted, "band"))
    cells = shared.where(F.col("m") <= group).select(F.col("band").alias("cell"), "id", F.lit(True).alias("held"), "m")
    hot = shared.where(F.col("m") > group).select("id").distinct()
    if hot.head(1):
        crowd = written(texts.select("id", "words").join(hot, "id"))
        parts = crowd.select("words").mapInPandas(counted_tokens, "part int, counts binary").groupBy("part").applyInPandas(summed, "part int, counts binary")
        counts = np.zeros(SKETCH, np.int64)
        for r in parts.collect():
            counts[r["part"] * (SKETCH // SKETCH_PARTS) :][: SKETCH // SKETCH_PARTS] = np.frombuffer(r["counts"], np.int64)
        often = texts.sparkSession.sparkContext.broadcast(counts)
        small = written(crowd.mapInPandas(rarest, "cell long, id long, held boolean"))
        fewer = small.groupBy("cell").agg(F.count("*").alias("m"), F.max("held").alias("any")).where("m > 1 and any")
        cells = cells.unionByName(small.join(fewer.drop("any"), "cell"))
    cells = cells.withColumn("k", F.ceil(F.col("m") / group).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    spread = cells.join(texts.select("id", "words"), "id").select("cell", "id", "held", "words", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    spread = spread.select("cell", "id", "held", "words", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInPandas(run, "a long, b long")


def classed(units: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """The paragraphs of `units` whose class stands in several rows, with the class's first place.

    row, at, n, start, end, class (long), occurrences, home, source, byte and upto (row, key, first byte and
    word after the last of that place).
    """
    placed = units.join(texts.select("row", "none", "key", "copies"), "row")
    order = F.struct("none", "key", F.col("row").alias("row"), "at", "start", "n")
    kinds = placed.groupBy("words").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.max("copies").alias("most"), F.sum("copies").alias("occurrences"), F.min(order).alias("first"))
    kinds = written(kinds.withColumn("id", F.monotonically_increasing_id()))
    links = connected_components(verified_links(kinds, similarity, bands=bands))
    named = kinds.join(links, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("root", "id"))
    classes = named.groupBy("class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"), F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"))
    classes = classes.where("low != high or most > 1").select("class", "occurrences", F.col("first.row").alias("home"), F.col("first.key").alias("source"), F.col("first.start").alias("byte"), (F.col("first.at") + F.col("first.n")).alias("upto"))
    name = [F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g")]  # 128 bits tell the kinds, grouped by their bytes, apart
    known = written(named.select(*name, "class").join(classes, "class"))
    return written(units.select("row", "at", "n", "start", "end", *name).join(known, ["h", "g"]).select("row", "at", "n", "start", "end", "class", "occurrences", "home", "source", "byte", "upto"))


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `df`: _key, passages.

    passages lists the paragraphs that stand in other rows too, in order: at and n (words before, words),
    start and end (bytes of the UTF-8 text), class (key and first byte of its first occurrence),
    occurrences, source (the key of the row where it stays) and removed (whether that is another place).
    Paragraphs overlap. Repeats inside one row alone don't count. Null and empty texts and texts under five
    words have none. Of rows with equal texts the one with the smallest key (a null key is the largest) counts
    as the first, and in the others all is removed; rows that share the smallest key too are all but one
    removed, whichever it is. Other columns aren't read. An empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("_t"))
    docs = docs.select("key", "_t", F.xxhash64("_t").alias("a"), F.xxhash64(F.lit(1), "_t").alias("b"))
    bits = slice_bits(docs.agg(F.sum(F.octet_length("_t"))).head()[0] or 0)
    docs = docs.withColumn("tag", F.col("a").bitwiseAND((1 << TAG_BITS) - 1))
    marks = written(colliding_values(docs, bits).groupBy("tag").agg(F.collect_set("value").alias("values")))
    again = written(docs.join(marks, "tag").withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    alike = again.groupBy("a", "b").agg(F.min(order).alias("f"), F.count("*").alias("copies"), F.first("values").alias("values"), F.first("_t").alias("text"))
    texts = written(alike.where("text is not null").select("a", "b", F.col("f.row").alias("row"), F.col("f.none").alias("none"), F.col("f.key").alias("key"), "copies", "text", "values"))
    units = written(colliding_paragraphs(texts, bits))
    found = classed(units, texts, similarity)
    longer = written(joined_paragraphs(texts.select("row", "text"), found))
    every = found.unionByName(classed(longer, texts, similarity, LONG_BANDS).withColumn("class", -F.col("class") - 1))
    gone = (F.col("row") != F.col("home")) | (F.col("at") >= F.col("upto"))  # paragraphs overlap: at home only what lies behind the first goes
    name = F.concat_ws(":", F.coalesce(F.col("source").cast("string"), F.lit("null")), F.col("byte"))
    item = F.struct("at", "n", "start", "end", name.alias("class"), "occurrences", "source", gone.alias("removed"))
    listed = written(every.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("passages")))
    homes = texts.select("a", "b", F.col("row").alias("home"), F.col("key").alias("mine")).join(listed.withColumnRenamed("row", "home"), "home")
    rows = again.select("key", "row", "a", "b").join(homes, ["a", "b"], "left")
    copied = F.transform("passages", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), p["start"].alias("start"), p["end"].alias("end"), p["class"].alias("class"), p["occurrences"].alias("occurrences"), F.when(p["removed"], p["source"]).otherwise(F.col("mine")).alias("source"), F.lit(True).alias("removed")))
    rows = rows.select(F.col("key").alias("_key"), F.when(F.col("row") == F.col("home"), F.col("passages")).otherwise(copied).alias("passages"))
    kinds = f"array<struct<at:int,n:int,start:int,end:int,class:string,occurrences:bigint,source:{kind},removed:boolean>>"
    rows = rows.select("_key", F.coalesce("passages", F.array().cast(kinds)).alias("passages"))
    alone = docs.select("key", "tag").join(marks.select("tag"), "tag", "left_anti").select(F.col("key").alias("_key"), F.array().cast(kinds).alias("passages"))
    return rows.unionByName(alone)


def words_in(passages) -> F.Column:
    """Words that the passages (ordered by `at`) cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    more = lambda s, p: F.struct(F.greatest(s["upto"], p["at"] + p["n"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), p["at"] + p["n"] - F.greatest(s["upto"], p["at"]))).cast("long").alias("n"))
    return F.aggregate(passages, start, more, lambda s: s["n"])


def words_removed(spans: list[tuple[int, int]]) -> int:
    """Words that (first, number) spans cover together."""
    total, upto = 0, 0
    for at, n in sorted(spans):
        total += max(0, at + n - max(at, upto))
        upto = max(upto, at + n)
    return total


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`text` without the (start, end) byte spans, which may overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:max(at, start)])
        at = max(at, end)
    return b"".join([*out, text[at:]])


def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document with the passages it shares with others.

    n_repeated and n_removed (words in shared paragraphs, and in those that go), n_links (shared paragraphs),
    class_ids, source_ids (documents where the removed ones stay), class_id (the smallest document in which
    any of its passages stands first, or itself) and repeated. Equal rows get equal results, but that one of
    them keeps its passages; null texts have none.
    """
    found = repeated_passages(table(spark, sf_dir, "documents"))
    gone = F.filter("passages", lambda p: p["removed"])
    sources = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["source"])))
    return found.select(
        F.col("_key").alias("doc_id"),
        words_in(F.col("passages")).alias("n_repeated"),
        words_in(gone).alias("n_removed"),
        F.size("passages").cast("long").alias("n_links"),
        F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["class"]))).alias("class_ids"),
        F.array_sort(F.array_distinct(F.transform(gone, lambda p: p["source"]))).alias("source_ids"),
        F.coalesce(F.least(F.get(sources, F.lit(0)), F.col("_key")), F.col("_key")).alias("class_id"),
        (F.size("passages") > 0).alias("repeated"),
    )
