"""Counting windows of a genome by super-k-mers.

Each window has a minimiser: the smallest hash among its m-mers, a hash that an m-mer shares with its reverse
complement. Neighbouring windows mostly share it, so a run of windows with one minimiser travels as one string (a
super-k-mer) instead of as many strings. All places of a window, on either strand, have its minimiser, so they meet
under that minimiser, and nothing else is shuffled.

Strings are dealt and sorted by their minimiser, and some minimisers at a time are counted: windows are rolling codes
of two bits a base, 31 bases a word, sorted and counted as numbers. Windows with a letter other than A, C, G and T
travel alone and are counted as text. Equal strings of a batch are added up before the shuffle, so what repeats (a
poly-A tract, a copied text) costs a row a batch. Windows of up to 12 bases have so few codes that each task counts
them in one array by code, and the counts are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a minimiser, at most, and windows from which on the minimisers at hand are counted.
MINIMISER, AT_ONCE = 11, 1 << 19
#: Bases of a batch that are cut at once, and bases of windows that are counted by code without minimisers.
CUT, SHORT = 1 << 21, 12
#: What no text holds.
BETWEEN = b"\xff"
#: Bases of one word of a code.
WORD = 31

_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
_LETTER = np.frombuffer(b"ACGT", np.uint8)
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


def opposite(text: bytes) -> bytes:
    """The other strand of a sequence; letters that aren't bases stay."""
    return text[::-1].translate(_COMPLEMENT)


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of all windows of up to 31 bases, built by doubling: a long window is two short ones."""
    out, have, part, width, left = None, 0, codes.astype(np.uint64), 1, size
    while left:
        if left & 1:
            out = part[: len(part)] if out is None else (out[: len(out) - width] << np.uint64(2 * width)) | part[have : have + len(out) - width]
            have += width
        left >>= 1
        if left:
            part, width = (part[: len(part) - width] << np.uint64(2 * width)) | part[width:], 2 * width
    return out


def window_words(codes: np.ndarray, size: int) -> list[np.ndarray]:
    """Words of the canonical form of every window, the leading bases first, and last whether it is the other
    strand's."""
    n = len(codes) - size + 1
    widths = [WORD] * (size // WORD) + [size % WORD] * (size % WORD > 0)
    back = (3 - codes.astype(np.int8)).astype(np.uint8)[::-1]
    ahead, behind, at = [], [], 0
    for width in widths:
        ahead.append(rolling(codes, width)[at : at + n])
        behind.append(rolling(back, width)[at : at + n][::-1])
        at += width
    less, open_ = np.zeros(n, bool), np.ones(n, bool)
    for a, b in zip(ahead, behind, strict=True):
        less |= open_ & (b < a)
        open_ &= a == b
    return [*[np.where(less, b, a) for a, b in zip(ahead, behind, strict=True)], less]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of numbers, so that minimisers are no particular sequences."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` numbers, by doubling."""
    have, step = x, 1
    while step * 2 <= width:
        have, step = np.minimum(have[: len(have) - step], have[step:]), step * 2
    return np.minimum(have[: len(x) - width + 1], have[width - step : width - step + len(x) - width + 1])


def _held(codes: np.ndarray, size: int) -> np.ndarray:
    """Whether each window holds bases only."""
    odd = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
    return odd[size:] == odd[:-size]


def spans(text: bytes, size: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of minimisers, offsets, numbers of windows) of every super-k-mer of a sequence of at least one window.

    Windows that hold another letter are in none.
    """
    codes = _CODE[np.frombuffer(text, np.uint8)]
    good = _held(codes, size)
    own = _mixed(window_words(np.minimum(codes, 3), m)[0])
    least = _least(own, size - m + 1)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(least)))
    kept = good[first]
    return least[first][kept], first[kept], many[kept]


def runs(text: bytes, size: int, m: int) -> Iterator[tuple[int, int, bytes]]:
    """(hash of the minimiser, offset, string) of every super-k-mer of a sequence, and of each window that holds
    another letter."""
    if len(text) >= size:
        yield from ((int(key), int(i), text[i : i + n - 1 + size]) for key, i, n in zip(*spans(text, size, m), strict=True))
        yield from ((hash_text(min(w, opposite(w))), i, w) for i, w in _odd_windows(text, size))


def hash_text(text: bytes) -> int:
    values = np.frombuffer(text, np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        return int(_mixed(np.array([(values * (np.arange(len(values), dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64)]))[0])


def _joined(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray, np.ndarray]]:
    """(rows, text, begin, row) of some pieces at a time: their text, in which BETWEEN follows each, where each
    begins, and the row of every letter."""
    for batch in batches:
        pieces = [(x or "").encode() + BETWEEN for x in batch["piece"].to_pylist()]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        part = (np.cumsum(lengths) - lengths) // cut
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            own = lengths[at]
            yield batch.slice(int(at[0]), len(at)), b"".join(pieces[at[0] : at[-1] + 1]), np.cumsum(own) - own, np.repeat(np.arange(len(at)), own)


def _odd_windows(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, window) of the windows of pieces that hold a letter that isn't a base."""
    codes = np.frombuffer(text, np.uint8)
    bases = _held(_CODE[codes], size)
    inside = _held(np.where(codes == BETWEEN[0], 4, 0), size)
    for i in np.flatnonzero(inside & ~bases).tolist():
        yield i, text[i : i + size]


def _cutting(size: int, m: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text, begin, row in _joined(batches, CUT):
            if len(text) < size:
                continue
            minimiser, at, many = spans(text, size, m)
            odd = list(_odd_windows(text, size))
            lengths = many + size - 1
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            letters = np.frombuffer(text, np.uint8)[np.arange(offsets[-1]) + np.repeat(at - offsets[:-1], lengths)]
            forms = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
            forms = pa.concat_arrays([forms, pa.array([w for _, w in odd], pa.binary())])
            bucket = np.concatenate([minimiser, np.array([hash_text(min(w, opposite(w))) for _, w in odd], np.uint64)]).view(np.int64)
            at = np.concatenate([at, np.array([i for i, _ in odd], np.int64)])
            same = forms.dictionary_encode()
            which = same.indices.to_numpy()
            first = np.zeros(len(same.dictionary), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            at, of = at[first], row[at[first]]
            start = rows["first"].to_numpy()[of] + at - begin[of]
            columns = [pa.array(bucket[first]), same.dictionary, pa.array(np.bincount(which, minlength=len(first))), pa.array(start.astype(np.int64)), *[rows[k].take(pa.array(of)) for k in keys]]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "form", "n", "start", *keys])

    return run


def super_kmers(pieces: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """(bucket, form, n, start, keys) of strings, dealt and sorted by bucket, the minimiser's hash: how often each
    occurs in a batch, and one of its places. pieces: (keys, first, piece), which hold each window once."""
    kinds = dict(pieces.dtypes)
    schema = ", ".join(["bucket long, form binary, n long, start long", *[f"`{k}` {kinds[k]}" for k in keys]])
    made = pieces.mapInArrow(_cutting(size, min(size, MINIMISER, max(4, size // 2)), list(keys)), schema)
    return made.repartition("bucket").sortWithinPartitions("bucket")


def _by_bucket(size: int, use: Callable[[pa.Table], pa.Table]):
    """use for whole buckets, as many at a time as have enough windows, while sorted strings pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            bucket = batch["bucket"].to_numpy()
            if windows >= AT_ONCE and bucket[-1] != last:
                cut = int(np.flatnonzero(bucket == bucket[-1])[0])
                yield from use(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held, windows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            windows += (pc.sum(pc.binary_length(batch["form"])).as_py() or 0) - (size - 1) * len(batch)
            last = bucket[-1]
        if held:
            yield from use(pa.Table.from_batches(held)).to_batches()

    return run


class _Windows:
    """The windows of some buckets' strings: their canonical words, string and place in it."""

    def __init__(self, group: pa.Table, size: int):
        forms = group["form"].to_pylist()
        self.size, self.n = size, group["n"].to_numpy()
        pure = np.array([len(f) > size or not f.translate(None, b"ACGT") for f in forms], bool)  # others travel alone
        own = [f for f, good in zip(forms, pure, strict=True) if good]
        lengths = np.array([len(f) for f in own], np.int64)
        self.forms, self.odd, self.which = own, [(f, i) for i, f in enumerate(forms) if not pure[i]], np.flatnonzero(pure)
        self.windows = lengths - size + 1
        self.string = np.repeat(np.arange(len(own)), self.windows)
        before = np.cumsum(self.windows) - self.windows
        self.place = np.arange(int(self.windows.sum())) - np.repeat(before, self.windows)
        codes = _CODE[np.frombuffer(b"".join(own), np.uint8)]
        at = np.repeat(np.cumsum(lengths) - lengths, self.windows) + self.place
        words = window_words(codes, size) if len(codes) else [np.zeros(0, np.uint64), np.zeros(0, bool)]
        *self.words, self.flipped = [w[at] for w in words]
        order = np.argsort(self.words[0]) if len(self.words) == 1 else np.lexsort(self.words[::-1])
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([w[order][1:] != w[order][:-1] for w in self.words], axis=0)
        self.order, self.heads = order, np.flatnonzero(new)
        self.copies = np.add.reduceat(self.n[self.which][self.string[order]], self.heads) if len(order) else np.zeros(0, np.int64)

    def texts(self, rows: np.ndarray) -> pa.Array:
        """Canonical forms of windows, as text."""
        return spelt([word[rows] for word in self.words], self.size)


def spelt(words: list[np.ndarray], size: int) -> pa.Array:
    """Texts of windows from their words."""
    n = len(words[0])
    out = np.empty((n, size), np.uint8)
    for k, word in enumerate(words):
        width = min(WORD, size - WORD * k)
        for j in range(width):
            out[:, WORD * k + j] = _LETTER[(word >> np.uint64(2 * (width - 1 - j))) & np.uint64(3)]
    offsets = np.arange(n + 1, dtype=np.int64) * size
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())).cast(pa.string())


def _count_short(pieces: DataFrame, size: int) -> DataFrame:
    """(kmer, copies) of windows of so few bases that a task's counts are no more rows than codes."""

    def rows(code: np.ndarray, n: np.ndarray, odd: dict[bytes, int]) -> pa.RecordBatch:
        codes, texts = pa.array(code.astype(np.int64)), pa.array([k.decode() for k in odd], pa.string())
        columns = [pa.concat_arrays([codes, pa.nulls(len(odd), pa.int64())]), pa.concat_arrays([pa.nulls(len(code), pa.string()), texts]), pa.array([*odd.values()], pa.int64()) if odd else pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["code", "odd", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, none = np.zeros(4**size, np.int64), np.zeros(0, np.int64)
        for _, text, _, _ in _joined(batches, max(1, CUT >> 3)):  # few enough for a core's cache
            if len(text) < size:
                continue
            codes = _CODE[np.frombuffer(text, np.uint8)]
            word = np.sort(window_words(np.minimum(codes, 3), size)[0][_held(codes, size)].astype(np.uint32))
            first = np.flatnonzero(np.concatenate([[len(word) > 0], word[1:] != word[:-1]]))
            copies[word[first]] += np.diff(np.append(first, len(word)))
            odd = Counter(min(w, opposite(w)) for _, w in _odd_windows(text, size))
            if odd:
                yield rows(none, none, odd)
        code = np.flatnonzero(copies)
        for i in range(0, len(code), AT_ONCE):
            yield rows(code[i : i + AT_ONCE], copies[code[i : i + AT_ONCE]], {})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = spelt([batch["code"].fill_null(0).to_numpy().astype(np.uint64)], size)
            yield pa.RecordBatch.from_arrays([pc.coalesce(batch["odd"], text), batch["copies"]], names=["kmer", "copies"])

    # a task has each code once: nothing is left to add up before the shuffle
    summed = pieces.mapInArrow(count, "code long, odd string, n long").repartition("code", "odd").groupBy("code", "odd").agg(F.sum("n").alias("copies"))
    return summed.mapInArrow(spell, "kmer string, copies long")


def count_windows(pieces: DataFrame, size: int) -> DataFrame:
    """(kmer, copies): every window by its canonical form, and how often it occurs on either strand."""
    if size <= SHORT:
        return _count_short(pieces, size)

    def count(group: pa.Table) -> pa.Table:
        own = _Windows(group, size)
        texts, copies = own.texts(own.order[own.heads]), own.copies
        if own.odd:
            found: dict[bytes, int] = {}
            for form, i in own.odd:
                name = min(form, opposite(form))
                found[name] = found.get(name, 0) + int(own.n[i])
            texts = pa.concat_arrays([texts, pa.array([k.decode() for k in found], pa.string())])
            copies = np.concatenate([copies, np.array(list(found.values()), np.int64)])
        return pa.table([texts, pa.array(copies)], names=["kmer", "copies"])

    return super_kmers(pieces, size, ()).mapInArrow(_by_bucket(size, count), "kmer string, copies long")


def single_windows(pieces: DataFrame, size: int, keys: tuple[str, ...], spell: bool = True) -> DataFrame:
    """(keys, start, kmer) of windows that occur once on either strand, as the sequence has them; without kmer, if
    they needn't be spelt."""
    kinds = dict(pieces.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "start long", *["kmer string"] * spell])

    def single(group: pa.Table) -> pa.Table:
        own = _Windows(group, size)
        rows = own.order[own.heads[own.copies == 1]]
        string = own.which[own.string[rows]]
        starts = group["start"].to_numpy()
        start = starts[string] + own.place[rows]
        seen: dict[bytes, int] = {}
        for form, i in own.odd:
            name = min(form, opposite(form))
            seen[name] = seen.get(name, 0) + int(own.n[i])
        odd = [(form, i) for form, i in own.odd if seen[min(form, opposite(form))] == 1]
        string = np.concatenate([string, np.array([i for _, i in odd], np.int64)]).astype(np.int64)
        start = np.concatenate([start, np.array([starts[i] for _, i in odd], np.int64)]).astype(np.int64)
        columns = [*[group[k].take(pa.array(string)).combine_chunks() for k in keys], pa.array(start)]
        if spell:
            kmers = [opposite(t.encode()).decode() if x else t for t, x in zip(own.texts(rows).to_pylist(), own.flipped[rows], strict=True)]
            columns.append(pa.array(kmers + [form.decode() for form, _ in odd], pa.string()))
        return pa.table(columns, names=[*keys, "start", *["kmer"] * spell])

    return super_kmers(pieces, size, keys).mapInArrow(_by_bucket(size, single), schema)
