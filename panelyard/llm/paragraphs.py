"""Removal of repeated passages: paragraph MinHash banding, exact Jaccard, components.

A paragraph is a line, or a block of lines between blank ones, of at least MIN_WORDS words
(lower-cased, split at white space, so that line breaks inside a block do not count). Different
paragraphs are joined where a band of their MinHash signatures collides; the number of bands is
the smallest that finds a pair at the threshold with the asked recall. Colliding paragraphs are
verified by the exact Jaccard similarity of their sets of five-word shingles, and links make
components. Of each component the first occurrence (by document, then position) stays, the
others are removals.

Passages also repeat inside otherwise different paragraphs, where no paragraph is like another.
They are met by runs of RUN_WORDS words that begin at anchors: the pair of words with the least
hash of every ANCHOR_WINDOW pairs in a row. Equal passages have equal anchors wherever they
stand, each passage of ANCHOR_WINDOW + RUN_WORDS - 1 words has one at least, and neighbouring runs
touch. Repeated runs in a row make one span, which is extended on both sides by the words that it
shares with its keeper, the place of the run's first occurrence; words and not hashes decide
there.

All these are reported. What goes is a matter of judgement: a later occurrence of WHOLE_WORDS words
or more is a copy and is removed. A shorter one (a quoted line, a phrase two authors share) is removed
only if it stands in COMMON_DOCS documents or more, as notices and boilerplate do; elsewhere
it is in its class, but stays.

Paragraphs fall together by 64 bits of a hash of their words, and are held equal only if 64 more
bits agree. Runs fall together by 64 bits, and the words beside them are compared as words. Each text
is read twice: once for signatures and runs, once for the words of colliding paragraphs and those
beside the spans.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import among, bitmap, durable, fresh, passing, raw, read, release, small_batches
from .components import components
from .forest import forest

SHINGLE, LEAST, RECALL, ROWS = 5, 0.8, 0.999, 3
#: Words of the shortest paragraph and of the shortest passage.
MIN_WORDS = 10
#: Passages of as many words are removed wherever they repeat; shorter ones if as many documents hold them.
WHOLE_WORDS, COMMON_DOCS = 40, 10
#: Words of an anchored run, and the word pairs in a row of which the least is an anchor. Runs are as
#: long as the window, so that they touch; every repeated passage of 23 words holds one.
RUN_WORDS = ANCHOR_WINDOW = 12
#: Words beside a run that may belong to its passage: with more, there would be a further anchor.
REACH = ANCHOR_WINDOW
#: Colliding paragraphs and their packed bytes that are compared at once; larger groups are compared block by block.
BLOCK, BLOCK_BYTES = 2000, 2 << 20
#: Bytes whose words are hashed at once.
PIECE = 1 << 18
#: Bytes of texts that are read together.
TOGETHER = 1 << 17
#: Tells the same run at different places apart.
PLACE = 0x9E3779B1
_rng = np.random.default_rng(40_009)
_MUL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_JOIN = _rng.integers(0, 1 << 63, max(RUN_WORDS, SHINGLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Shingles hashed at once, few enough to stay near the processor.
TILE = 1 << 14


def bands(least: float = LEAST, recall: float = RECALL, rows: int = ROWS) -> int:
    """The smallest number of bands of `rows` minima that catches a pair at `least` with probability `recall`."""
    n = 1
    while 1 - (1 - least**rows) ** n < recall:
        n += 1
    return n


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))


class Text:
    """A text's words: where they start and end, in bytes, and a 64-bit number for each, by its letters and their order."""

    powers: tuple = ()
    points: np.ndarray | None = None

    def __init__(self, text: bytes):
        self.text, self.low = text, text.lower()
        code = np.frombuffer(self.low, np.uint8)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.starts, self.ends = edge[::2], edge[1::2]

    def words(self, first: int, after: int) -> bytes:
        """Some words, with a space between."""
        return b" ".join(self.low[self.starts[first] : self.ends[after - 1]].split()) if after > first else b""

    def hashes(self) -> np.ndarray:
        if not Text.powers:
            Text.powers = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)
        up, down = Text.powers
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            first = int(self.starts[at])
            after = max(at + 1, int(np.searchsorted(self.ends, first + PIECE, "right")))
            starts, ends = self.starts[at:after] - first, self.ends[at:after] - first
            if ends[-1] > PIECE:  # one word longer than a piece
                out[at] = xxhash.xxh64_intdigest(self.low[first : first + int(ends[-1])])
            else:
                sums = np.zeros(int(ends[-1]) + 1, np.uint64)
                np.cumsum(np.frombuffer(self.low, np.uint8, int(ends[-1]), first) * up[: int(ends[-1])], out=sums[1:])
                out[at:after] = (sums[ends] - sums[starts]) * down[starts]
            at = after
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out

    def paragraphs(self) -> np.ndarray:
        """(first word, word after the last) of the lines, then of the blocks of two lines or more
        between blank lines, of MIN_WORDS words at least. Lines of under SHINGLE words at a block's
        ends (headings, labels, a last word) are left out of it."""
        cut = np.searchsorted(self.starts, np.flatnonzero(np.frombuffer(self.low, np.uint8) == 10))
        first, after = np.append(0, cut), np.append(cut, len(self.starts))
        number = np.flatnonzero(after > first)
        first, after = first[number], after[number]
        lines = after - first >= MIN_WORDS
        border = np.flatnonzero(np.diff(number) != 1) + 1
        i, j = np.append(0, border)[: len(number)], np.append(border, len(number))[: len(number)]
        long = np.flatnonzero(after - first >= SHINGLE)
        if len(long):
            low, high = np.searchsorted(long, i), np.searchsorted(long, j)
            some = high > low  # of short lines only, all count
            i, j = np.where(some, long[np.minimum(low, len(long) - 1)], i), np.where(some, long[high - 1] + 1, j)
        i, j = i[j - i > 1], j[j - i > 1]
        blocks = after[j - 1] - first[i] >= MIN_WORDS
        return np.stack([np.append(first[lines], first[i[blocks]]), np.append(after[lines], after[j[blocks] - 1])], axis=1)

    def chars(self, marks: np.ndarray) -> np.ndarray:
        """Code points before each of the byte positions."""
        if self.text.isascii():
            return marks
        if self.points is None:
            self.points = np.append(0, np.cumsum((np.frombuffer(self.text, np.uint8) & 0xC0) != 0x80))
        return self.points[marks]


class Texts(Text):
    """Several texts, read as one with blank lines between, so that no word, line or block crosses them:
    `base` is the byte at which each begins, `bounds` its first word (and, at the end, what follows the last)."""

    def __init__(self, texts: list[bytes]):
        super().__init__(b"\n\n".join(texts))
        self.base = np.cumsum([0, *(len(t) + 2 for t in texts)])
        self.bounds = np.searchsorted(self.starts, self.base)

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Which text each of the words stands in."""
        return np.searchsorted(self.bounds, words, "right") - 1

    def places(self, marks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Code points of their texts before each of the byte positions."""
        return self.chars(marks) - self.chars(self.base[rows])


def together(texts: list[bytes]):
    """(first, after the last) of texts in a row of TOGETHER bytes or little more."""
    first, held = 0, 0
    for k, t in enumerate(texts, 1):
        held += len(t)
        if held >= TOGETHER or k == len(texts):
            yield first, k
            first, held = k, 0


def anchors(hashes: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """The words at which runs begin: the leftmost least of every ANCHOR_WINDOW pairs in a row (of all, if they are fewer)
    of each text, of which `bounds` has the first words (one text, if not given)."""
    n = len(hashes) - RUN_WORDS + 1
    if n < 1:
        return np.empty(0, np.int64)
    bounds = np.array([0, len(hashes)]) if bounds is None else bounds
    first, size = bounds[:-1], np.diff(bounds) - RUN_WORDS + 1
    pair = (hashes[:n] * _JOIN[0] + hashes[1 : n + 1] * _JOIN[1]) & np.uint64(0xFFFFFFFF00000000)
    pair |= np.arange(n, dtype=np.uint64)
    found = []
    many = size >= ANCHOR_WINDOW
    if many.any():
        low, width = pair, 1
        while 2 * width <= ANCHOR_WINDOW:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if ANCHOR_WINDOW > width:
            low = np.minimum(low[: width - ANCHOR_WINDOW], low[ANCHOR_WINDOW - width :])
        own = np.zeros(len(low) + 1, np.int8)
        own[first[many]], own[(first + size)[many] - ANCHOR_WINDOW + 1] = 1, -1
        least = (low[np.cumsum(own[:-1], dtype=np.int8).view(bool)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append(least[np.diff(least, prepend=-1) != 0])
    few = (size > 0) & ~many
    if few.any():
        ends = np.stack([first[few], (first + size)[few]], axis=1).ravel()
        least = np.minimum.reduceat(np.append(pair, np.uint64(0)), ends)[::2]
        found.append((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.sort(np.concatenate([np.empty(0, np.int64), *found]))


def joined(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for `size` words in a row, beginning at each word."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _JOIN[k]
    return (out ^ (out >> np.uint64(31))) * np.uint64(_BASE)


def run_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for RUN_WORDS words in a row, beginning at each word of `at`: those of shorter runs put together, twice as long a step."""
    part, width, out, done = hashes, 1, np.zeros(len(at), np.uint64), 0
    while len(at):
        if RUN_WORDS & width:
            out = out * _JOIN[width % len(_JOIN)] + part[at + done]
            done += width
        if done == RUN_WORDS:
            break
        part, width = part[:-width] * _JOIN[width % len(_JOIN)] + part[width:], 2 * width
    return (out ^ (out >> np.uint64(31))) * np.uint64(_BASE)


def unit_of(whole: bytes) -> int:
    return xxhash.xxh64_intdigest(whole) - (1 << 63)


def _named(hashes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """(unit, check): 128 bits of hash of each paragraph's words."""
    digest, code = xxhash.xxh3_128_digest, memoryview(hashes.tobytes())
    return np.frombuffer(b"".join([digest(code[8 * a : 8 * e]) for a, e in parts.tolist()]), np.int64).reshape(-1, 2)


def minima(hashes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """MinHash signatures of sets given one after another with their sizes: the least of each of k
    multiply-and-add hashes, TILE shingles at a time."""
    out, first = np.full((k, len(sizes)), np.iinfo(np.uint64).max), np.cumsum(np.append(0, sizes[:-1]))
    room = np.empty(TILE, np.uint64)
    for at in range(0, len(hashes), TILE):
        part = hashes[at : at + TILE]
        mixed = room[: len(part)]
        own = slice(int(np.searchsorted(first, at, "right")) - 1, int(np.searchsorted(first, at + len(part))))
        starts = np.maximum(first[own] - at, 0)
        for i in range(k):
            np.multiply(part, _MUL[i], out=mixed)
            np.add(mixed, _ADD[i], out=mixed)
            np.minimum(out[i, own], np.minimum.reduceat(mixed, starts), out=out[i, own])
    return np.ascontiguousarray(out.T)


_PARAGRAPH = "unit long, check long, at int, n_words int, start int, end int, sigs array<long>"


def units(docs: DataFrame, id_col: str, text: str, n_bands: int, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, runs, paragraphs) of every text with words enough: its hash, the hashes of its
    runs in order, and its paragraphs with their place (words, and code points) and band
    signatures (once per batch for each paragraph)."""
    salt = np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def nested(lengths, values):
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in raw(b, text)]
            rows_, keys, runs, n_runs, names, n_names, spots, sets, signed, known = [], [], [], [], [], [], [], [], [], set()
            for i, j in together(texts):
                own = Texts(texts[i:j])
                held = np.flatnonzero(np.diff(own.bounds) >= MIN_WORDS)
                if not len(held):
                    continue
                hashes = own.hashes()
                rows_.append(i + held)
                keys += [xxhash.xxh64_intdigest(texts[k], 42) for k in rows_[-1].tolist()]
                at = anchors(hashes, own.bounds)
                runs.append(run_hashes(hashes, at))
                n_runs.append(np.diff(np.searchsorted(at, own.bounds))[held])
                parts = own.paragraphs()
                parts = parts[np.argsort(own.rows(parts[:, 0]), kind="stable")]
                row = own.rows(parts[:, 0])
                names.append(_named(hashes, parts))
                n_names.append(np.bincount(row, minlength=j - i)[held])
                spots.append(np.stack([parts[:, 0] - own.bounds[row], parts[:, 1] - parts[:, 0], own.places(own.starts[parts[:, 0]], row), own.places(own.ends[parts[:, 1] - 1], row)], axis=1))
                made = joined(hashes)
                for (a, e), u in zip(parts.tolist(), names[-1][:, 0].tolist(), strict=True):
                    signed.append(u not in known)
                    if signed[-1]:
                        known.add(u)
                        sets.append(made[a : e - SHINGLE + 1])
            if not keys:
                continue
            mixed = np.tile(salt, (len(sets), 1))
            if sets:
                low = minima(np.concatenate(sets), np.array([len(x) for x in sets]), n_bands * rows).reshape(len(sets), n_bands, rows)
                for r in range(rows):
                    mixed = (mixed ^ low[:, :, r]) * np.uint64(_BASE)
                    mixed ^= mixed >> np.uint64(29)
            name, spot = np.concatenate(names), np.concatenate(spots).astype(np.int32)
            sigs = nested(np.array(signed, np.int64) * n_bands, pa.array(mixed.ravel().view(np.int64)))
            columns = [pa.array(name[:, 0]), pa.array(name[:, 1]), *(pa.array(np.ascontiguousarray(spot[:, k])) for k in range(4)), sigs]
            paragraphs = pa.StructArray.from_arrays(columns, ["unit", "check", "at", "n_words", "start", "end", "sigs"])
            own = [b.column(0).take(pa.array(np.concatenate(rows_))), pa.array(np.array(keys, np.uint64).view(np.int64))]
            lists = [nested(np.concatenate(n_runs), pa.array(np.concatenate(runs).view(np.int64))), nested(np.concatenate(n_names), paragraphs)]
            yield pa.RecordBatch.from_arrays([*own, *lists], ["doc_id", "h", "runs", "paragraphs"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows_ = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias(text))
    return rows_.mapInArrow(run, f"doc_id {kind}, h long, runs array<long>, paragraphs array<struct<{_PARAGRAPH.replace(' ', ':').replace(',:', ',')}>>")


def _hits(found: DataFrame, sent) -> DataFrame:
    """(unit, doc_id, h, k) of the runs that may be in the bitmap, one row each."""

    def run(batches):
        mask = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            runs = b.column("runs")
            unit, sizes = runs.flatten().to_numpy(zero_copy_only=False), np.diff(runs.offsets.to_numpy())
            row, first = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = np.flatnonzero(among(mask, unit))
            k = pa.array((hit - first[hit]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(unit[hit]), b.column("doc_id").take(pa.array(row[hit])), b.column("h").take(pa.array(row[hit])), k], ["unit", "doc_id", "h", "k"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "h", "runs").mapInArrow(run, f"unit long, doc_id {kind}, h long, k int")


_LOOKED = ["unit", "packed", "h", "k", "left", "word", "char", "beside"]


def _edge_key(unit, h, k, left):
    """Tells the edges of runs apart, as the keys of the bitmap do."""
    return unit ^ h ^ (2 * k + left) * PLACE


def _second_look(docs: DataFrame, text: str, sent) -> DataFrame:
    """The words of paragraphs in the bitmap (unit, packed), and the edges of runs in it
    (unit, h, k, left, word, char, beside): the edge's place in words and in code points, and the
    text beside it, of REACH words at most. Texts whose hash is not in it have neither. Hashes of
    texts, paragraphs and edges share the one bitmap; exact joins follow."""

    def run(batches):
        mask = np.frombuffer(sent.value, np.uint8)

        for b in batches:
            out, seen = [[] for _ in _LOOKED], set()
            texts = [t or b"" for t in raw(b, text)]
            h = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            held = np.unique(h, return_index=True)[1]  # equal texts are looked at once
            held = np.sort(held[among(mask, h[held])])
            texts, h = [texts[k] for k in held.tolist()], h[held]
            for i, j in together(texts):
                own = Texts(texts[i:j])
                hashes = own.hashes()
                parts = own.paragraphs()
                name = _named(hashes, parts)[:, 0]
                for k in np.flatnonzero(among(mask, name)).tolist():
                    u = int(name[k])
                    if u not in seen:
                        seen.add(u)
                        out[0].append(u)
                        out[1].append(zlib.compress(own.low[own.starts[parts[k, 0]] : own.ends[parts[k, 1] - 1]], 1))
                blank = [None] * (len(out[0]) - len(out[2]))
                for column in out[2:]:
                    column += blank
                at = anchors(hashes, own.bounds)
                row = own.rows(at)
                name, number = run_hashes(hashes, at).view(np.int64), np.arange(len(at)) - np.searchsorted(at, own.bounds)[row]
                for left in (1, 0):
                    hit = np.flatnonzero(among(mask, _edge_key(name, h[i + row], number, left)))
                    if not len(hit):
                        continue
                    in_, word = row[hit], at[hit] + (0 if left else RUN_WORDS)
                    edge = own.starts[word] if left else own.ends[word - 1]
                    far = own.starts[np.maximum(own.bounds[in_], word - REACH)] if left else own.ends[np.minimum(own.bounds[in_ + 1], word + REACH) - 1]
                    spans = zip(far.tolist(), edge.tolist(), strict=True) if left else zip(edge.tolist(), far.tolist(), strict=True)
                    columns = (name[hit], [None] * len(hit), h[i + in_], number[hit], [bool(left)] * len(hit), word - own.bounds[in_], own.places(edge, in_), [own.text[x:y] for x, y in spans])
                    for column, values in zip(out, columns, strict=True):
                        column += values if isinstance(values, list) else values.tolist()
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], _LOOKED)

    small_batches(docs.sparkSession)
    return docs.select(F.col(text).alias(text)).mapInArrow(run, "unit long, packed binary, h long, k int, left boolean, word int, char int, beside binary")


def _spanning(names: np.ndarray, sets: list[np.ndarray], least: float):
    """Links (a, b) of one group that connect what all its pairs of a Jaccard similarity of `least` or more connect."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        shared = int((both[1:] == both[:-1]).sum())
        if shared >= least * (len(both) - shared) - 1e-12:
            yield names[:1], names[1:]
        return
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(np.append(0, size))
    mark = np.zeros(int(flat.max()) + 1, np.int64)

    def near(i, others):
        mine = flat[starts[i] : starts[i + 1]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[flat], starts[:-1])[others]
        mark[mine] = 0
        return shared >= least * (size[i] + size[others] - shared) - 1e-12

    for i, found in forest(len(names), near):
        yield np.full(len(found), names[i]), names[found]


def shingles(packed: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each of the packed words."""
    texts, out = [zlib.decompress(x) for x in packed], []
    for i, j in together(texts):
        own = Texts(texts[i:j])
        made = joined(own.hashes())
        for a, e in pairwise(own.bounds.tolist()):
            x = np.sort(made[a : max(a, e - SHINGLE + 1)])
            out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return out


def _verify(least: float, unpack):
    """Rows (sig, low, high, unit, packed) in order of their groups -> spanning links (a, b) of each group."""

    def rows(batches):
        for b in batches:
            keys, packed = [b.column(c).to_pylist() for c in ("sig", "low", "high", "unit")], b.column("packed").to_pylist()
            for i, j in together(packed):
                own = dict(zip(keys[3][i:j], packed[i:j], strict=True))  # a unit stands in several groups
                sets = dict(zip(own, unpack(list(own.values())), strict=True))
                for *k, u in zip(*(c[i:j] for c in keys), strict=True):
                    yield k, u, sets[u]

    def groups(batches):
        key, units_, sets = None, [], []
        for k, u, x in rows(batches):
            if k != key:
                if len(units_) > 1:
                    yield units_, sets
                key, units_, sets = k, [], []
            units_.append(u)
            sets.append(x)
        if len(units_) > 1:
            yield units_, sets

    def run(batches):
        a, b = [], []
        cat = lambda v: pa.array(np.concatenate([np.empty(0, np.int64), *v]))
        for units_, sets in groups(batches):
            order = sorted(range(len(units_)), key=units_.__getitem__)
            for x, y in _spanning(np.array([units_[i] for i in order]), [sets[i] for i in order], least):
                a.append(x)
                b.append(y)
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])

    return run


def collisions(paragraphs: DataFrame) -> DataFrame:
    """(sig, unit): the paragraphs of every band signature that different ones share."""
    pairs = paragraphs.select("unit", F.explode("sigs").alias("sig")).select("sig", "unit")
    often = durable(pairs.groupBy("sig").agg(F.min("unit").alias("x"), F.max("unit").alias("y")).where("x <> y").select("sig"), "passages-collisions")
    return durable(passing(pairs, "sig", bitmap(often)).join(often, "sig", "left_semi").distinct(), "passages-members")


def near_links(members: DataFrame, sets: DataFrame, least: float, unpack) -> DataFrame:
    """(a, b) links that connect what all pairs of a Jaccard similarity of `least` or more within a group
    connect, of (sig, unit) members and their (unit, packed), from lists of which `unpack` has the sorted distinct
    hashes of each one's shingles."""
    # groups with the same members in several bands are compared once; large groups block by block
    sized = members.join(sets.select("unit", F.octet_length("packed").alias("n")), "unit")
    groups = sized.groupBy("sig").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.xxhash64("unit") % (1 << 40)).alias("who"), F.min("unit").alias("x"))
    parts = F.ceil(F.greatest(F.col("g") / BLOCK, F.col("n") / BLOCK_BYTES)).cast("int")
    groups = groups.groupBy("g", "n", "who", "x").agg(F.min("sig").alias("sig")).select("sig", parts.alias("parts"))
    dealt = members.join(groups, "sig").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = dealt.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "unit").join(sets, "unit")
    key = ["sig", "low", "high"]
    return tasks.repartition(*key).sortWithinPartitions(*key).select(*key, "unit", "packed").mapInArrow(_verify(least, unpack), "a long, b long")


def _judged(rows: DataFrame, place: list[str], carried: list[str]) -> DataFrame:
    """rows (doc_id, h, place..., carried...) with `twin`, which of several equal documents a row belongs
    to, and `removed`: it is not the keeper."""
    first = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("h") == F.col("keeper.h"))
    for c in place:
        first = first & (F.col(c) == F.col(f"keeper.{c}"))
    twin = F.row_number().over(Window.partitionBy("doc_id", "h", *place).orderBy(place[0]))
    dealt = rows.select("doc_id", "h", *place, *carried, first.alias("first")).repartition("doc_id", "h")
    return dealt.withColumn("twin", twin).withColumn("removed", ~F.col("first") | (F.col("twin") > 1)).drop("first")


def _decided(spans: DataFrame) -> DataFrame:
    """spans (removed: a later occurrence, n_words, n_docs, ...) with `removed` as the module's judgement has it."""
    return spans.withColumn("removed", F.expr(f"removed and (n_words >= {WHOLE_WORDS} or n_docs >= {COMMON_DOCS})"))


def _firsts(rows: DataFrame, key: str, place: list[str]) -> DataFrame:
    """(key, n_docs, keeper): how many documents hold each key that occurs more than once, and its first
    place. Each document's rows are added up first, so that a common key is few rows a task."""
    last = F.col("doc_id").isNull().alias("last")
    own = rows.groupBy(key, "doc_id", "h").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("p"))
    found = own.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min(F.struct(last, "doc_id", "p", "h")).alias("keeper"))
    return found.where("n > 1").select(key, "n_docs", F.struct("keeper.doc_id", *(f"keeper.p.{c}" for c in place), "keeper.h").alias("keeper"))


def _islands(runs: DataFrame) -> DataFrame:
    """Spans of repeated runs in a row, kept and removed ones apart, with two rows each: the left and the
    right edge (doc_id, h, twin, island, removed, n_docs, left, unit, k); n_docs is that of its rarest run."""
    own = Window.partitionBy("doc_id", "h", "twin").orderBy("k")
    new = (F.col("k") - F.lag("k").over(own) != 1) | (F.col("removed") != F.lag("removed").over(own))
    marked = runs.withColumn("new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(own))
    spans = marked.groupBy("doc_id", "h", "twin", "island", "removed").agg(F.min(F.struct("k", "unit")).alias("first"), F.max(F.struct("k", "unit")).alias("last"), F.min("n_docs").alias("n_docs"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), "first.*"), F.struct(F.lit(False).alias("left"), "last.*")))
    return spans.select("doc_id", "h", "twin", "island", "removed", "n_docs", sides.alias("s")).select("doc_id", "h", "twin", "island", "removed", "n_docs", "s.left", "s.unit", "s.k")


def _shared(pairs: DataFrame) -> DataFrame:
    """pairs (left, beside, other, ...) with `n`, the words that both share next to the edge, and `chars`, how far they reach."""

    def run(batches):
        for b in batches:
            n, chars = [], []
            for left, x, y in zip(b.column("left").to_pylist(), b.column("beside").to_pylist(), b.column("other").to_pylist(), strict=True):
                step, shared = -1 if left else 1, 0
                words = (x or b"").lower().split()[::step]
                for v, w in zip(words, (y or b"").lower().split()[::step], strict=False):
                    if v != w:
                        break
                    shared += 1
                n.append(shared)
                chars.append(_reach(x, shared, left))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32()), pa.array(chars, pa.int32())], [*b.schema.names, "n", "chars"])

    return pairs.mapInArrow(run, pairs.select("*").schema.add("n", "integer").add("chars", "integer"))


def _reach(beside: bytes | None, n: int, left: bool) -> int:
    """Code points from an edge over the n words next to it."""
    if not n:
        return 0
    own = Text(beside)
    return len((beside[own.starts[-n] :] if left else beside[: own.ends[n - 1]]).decode(errors="replace"))


def _widened(kept: DataFrame) -> DataFrame:
    """kept (left, beside, n, ...) with `chars`."""

    def run(batches):
        for b in batches:
            far = [_reach(x, n or 0, left) for left, x, n in zip(b.column("left").to_pylist(), b.column("beside").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far, pa.int32())], [*b.schema.names, "chars"])

    return kept.mapInArrow(run, kept.select("*").schema.add("chars", "integer"))


def _extended(edges: DataFrame, keepers: DataFrame, looked: DataFrame) -> DataFrame:
    """Islands with their edges moved over the words shared with the keeper; a kept one is as wide as the widest it stands for."""
    at = lambda h, k: (F.col("e.unit") == F.col("x.unit")) & (F.col("e.left") == F.col("x.left")) & (F.col(h) == F.col("x.h")) & (F.col(k) == F.col("x.k"))
    own = edges.join(keepers.drop("n_docs"), "unit").alias("e").join(looked.alias("x"), at("e.h", "e.k")).select("e.*", "x.word", "x.char", "x.beside")
    own = durable(own, "passages-own")
    others = own.where("removed").alias("e").join(looked.alias("x"), at("e.keeper.h", "e.keeper.k"), "left").select("e.*", F.col("x.beside").alias("other"))
    base = ["doc_id", "h", "twin", "island", "removed", "n_docs", "left", "unit", "word", "char", F.col("keeper.doc_id").alias("keeper_doc_id")]
    others = durable(_shared(others.select(*base, "beside", "other")).drop("beside", "other"), "passages-shared")
    widest = others.groupBy("unit", "left").agg(F.max("n").alias("n"))
    kept = _widened(own.where("not removed").join(widest, ["unit", "left"], "left").select(*base, "beside", "n"))
    moved = others.unionByName(kept.drop("beside")).withColumn("n", F.coalesce("n", F.lit(0)))
    of = lambda left, a, b: F.max(F.when(F.col("left") == left, (F.col(a) - F.col(b)) if left else (F.col(a) + F.col(b))))
    spans = moved.groupBy("doc_id", "h", "twin", "island", "removed", "n_docs").agg(
        of(True, "char", "chars").alias("start"), of(False, "char", "chars").alias("end"), of(True, "word", "n").alias("w0"), of(False, "word", "n").alias("w1"),
        *(F.max(F.when(F.col("left"), F.col(c))).alias(a) for c, a in (("unit", "class_id"), ("keeper_doc_id", "keeper_doc_id"))),
    )
    # spans of a text that meet are one
    before = Window.partitionBy("doc_id", "h", "twin", "removed").orderBy("w0", "w1")
    new = F.coalesce((F.col("w0") > F.max("w1").over(before.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    spans = spans.withColumn("new", new).withColumn("part", F.sum("new").over(before))
    first = lambda c: F.min_by(c, F.struct("w0", "w1")).alias(c)
    spans = spans.groupBy("doc_id", "h", "twin", "removed", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("n_docs").alias("n_docs"), (F.max("w1") - F.min("w0")).cast("int").alias("n_words"), first("class_id"), first("keeper_doc_id"))
    return _decided(spans.where(f"n_words >= {MIN_WORDS}").drop("part"))


def _found(docs: DataFrame, id_col: str, text: str, least: float, recall: float) -> DataFrame:
    """What passages() returns, with h, the text's hash, and twin, which of several equal documents it is."""
    spark = docs.sparkSession
    found = durable(units(docs, id_col, text, bands(least, recall)), "passages-units")
    signed = found.select("doc_id", "h", F.explode("paragraphs").alias("p")).select("doc_id", "h", "p.*")
    members = collisions(signed)
    wanted = durable(members.select("unit").distinct(), "passages-wanted")
    whole = durable(signed.drop("sigs"), "passages-paragraphs")
    release(spark)
    # the first place of every run that occurs more than once
    often = durable(found.select(F.explode("runs").alias("unit")).groupBy("unit").count().where("count > 1").select("unit"), "passages-repeated")
    hits = durable(_hits(found, bitmap(often)), "passages-hits")
    release(spark, found, often)
    keepers = durable(_firsts(hits, "unit", ["k"]), "passages-keepers")
    release(spark)
    edges = durable(_islands(_judged(hits.join(keepers, "unit"), ["k"], ["unit", "n_docs"])), "passages-edges")
    release(spark, hits)
    # all edges are looked at in their own text, and those of removals in the keeper's too
    theirs = edges.where("removed").select("unit", "left").distinct().join(keepers, "unit").select("unit", "keeper.h", "keeper.k", "left")
    keys = edges.select("unit", "h", "k", "left").union(theirs).select("h", F.expr(f"unit ^ h ^ ((2L * k + int(left)) * {PLACE}L)").alias("key")).distinct()
    keys = durable(keys, "passages-keys")
    texts = durable(keys.select("h").union(whole.join(wanted, "unit", "left_semi").select("h")).distinct(), "passages-texts")
    sought = texts.union(wanted).union(keys.select("key"))
    looked = durable(_second_look(docs, text, bitmap(sought)), "passages-looked")
    release(spark, keys, texts)
    sets = looked.where("packed is not null").select("unit", "packed").join(wanted, "unit", "left_semi")
    sets = durable(sets.groupBy("unit").agg(F.first("packed").alias("packed")), "passages-words")
    root = durable(components(near_links(members, sets, least, shingles), "passages-cc"), "passages-classes")
    release(spark, members, wanted, sets)
    # paragraphs: those with the first 64 bits of their keeper's hash but not the others go
    classed = whole.join(root, whole.unit == root.node, "left").withColumn("class_id", F.coalesce("root", "unit")).drop("node", "root")
    many = classed.groupBy("class_id").count().where("count > 1").select("class_id")
    classed = durable(classed.join(many, "class_id", "left_semi"), "passages-classed")
    kept = durable(_firsts(classed, "class_id", ["at", "n_words", "unit", "check"]), "passages-firsts")
    classed = classed.join(kept, "class_id").where("unit <> keeper.unit or check = keeper.check")
    columns = ["doc_id", "start", "end", "n_words", "n_docs", "class_id", "keeper_doc_id", "removed", "h", "twin"]
    carried = ["start", "end", "n_docs", "class_id", "keeper_doc_id"]
    judged = _decided(_judged(classed.withColumn("keeper_doc_id", F.col("keeper.doc_id")), ["at", "n_words"], carried)).select(columns)
    # passages inside other paragraphs; equal texts bring the same edge more than once
    beside = looked.where("packed is null").drop("packed").dropDuplicates(["unit", "h", "k", "left"])
    return judged.unionByName(_extended(edges, keepers, beside).select(columns))


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """Every occurrence of a passage that occurs more than once, exactly or nearly: (doc_id,
    start, end, n_words, n_docs, class_id, keeper_doc_id, removed), start and end in code points.

    Paragraphs come with their class; passages inside other paragraphs as whole spans, whose class
    is their first run's and whose keeper is that run's first document. n_docs is the number of
    different documents (by id and text) that hold the class; for spans, those that hold the rarest
    of their runs at an anchor (of passages of under 23 words, not all may). The first occurrence by document id and place (null ids last) stays, others are
    `removed` if they have WHOLE_WORDS words or COMMON_DOCS documents at least. Texts that are null,
    empty or have under MIN_WORDS words have no rows. Rows of documents that repeat count as
    occurrences of their own: one stays, the others' passages are removed. Other columns are not
    read. An empty table gives no rows.
    """
    return _found(docs, id_col, text, least, recall).drop("h", "twin")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with the removed passages cut out of their texts. Other rows are as they were.

    Spans belong to rows by id, text and, among equal rows, their number, so repeated and null
    ids are fine: of equal rows one keeps its text."""
    spans, key, h, twin = fresh(docs, "cut_spans", "cut_id", "cut_hash", "cut_twin")
    gone = _found(docs, id_col, text, least, RECALL).where("removed")
    gone = gone.groupBy(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("twin").alias(twin)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans))
    body = F.col(text)

    def step(acc, x):
        part = F.when(x["start"] > acc["at"], F.concat(acc["out"], F.substring(body, acc["at"] + 1, x["start"] - acc["at"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), part.alias("out"))

    left = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    own = docs.withColumn(h, F.xxhash64(text))
    own = own.withColumn(twin, F.row_number().over(Window.partitionBy(id_col, h).orderBy(F.lit(0)))).alias("d")
    joined = own.join(gone.alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"g.{key}")) & (F.col(f"d.{h}") == F.col(f"g.{h}")) & (F.col(f"d.{twin}") == F.col(f"g.{twin}")), "left")
    joined = joined.select(*(F.col(f"d.{c}") for c in docs.columns), F.col(f"g.{spans}"))
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), left).otherwise(body)).select(docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of repeated passages, paragraphs with their class."""
    return passages(read(spark, sf_dir, "documents"))
