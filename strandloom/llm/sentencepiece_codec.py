"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has one node for each position between characters and one edge for each piece.
The search keeps, for each of the last ``max_piece`` positions, a backpointer (the piece that
ends there). No later piece can start before that window, so as soon as the backpointer paths
of all positions in the window meet in one boundary, what lies before it is final: its ids are
committed and its state is dropped. Memory follows the window, not the text.

Two kinds of model are served by the same search:

* unigram models: the best-scoring path into each position survives;
* BPE models: an edge may follow another only if merging their joined text yields just these two
  pieces. With this rule each prefix has exactly one path into its end, the one that merging by
  rank would give, so the ids equal those of the merge procedure.

User-defined pieces stand wherever their text does: a BPE model cuts the text at them first, the longest at a
place, and a unigram model scores them above its other pieces. A run of characters that no piece
covers has one unknown id, unless the model falls back to bytes.

Spaces start pieces and occur inside none (but in runs of spaces), so a boundary before a run of
spaces is one where all paths meet; words between such boundaries are searched once and their
ids remembered, in a dictionary of bounded size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public model lies on the driver; executors get it by broadcast.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NEVER = float("-inf")
#: Words and pairs of pieces whose results a worker remembers, and the longest such word.
REMEMBERED, LONGEST_REMEMBERED = 1 << 18, 48


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else {5: 4, 1: 8}[wire]
            yield number, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and normaliser switches of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze, self.byte_fallback = UNIGRAM, True, True, False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind = trainer.get(3, UNIGRAM)
                self.byte_fallback = bool(trainer.get(35, 0))
            elif number == 3:
                normaliser = dict(_fields(value))
                self.dummy_prefix = bool(normaliser.get(3, 1))
                self.squeeze = bool(normaliser.get(4, 1))
                if normaliser.get(2):
                    raise ValueError("models with a character map aren't supported; use an identity normaliser")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if self.kind == BPE and UNUSED in self.kinds:
            raise ValueError("BPE models with unused pieces aren't supported")
        whole = (NORMAL,) if self.kind == BPE else (NORMAL, USER_DEFINED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in whole}
        defined = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == USER_DEFINED}
        normal = [x for x, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        if self.kind == UNIGRAM:
            for piece, i in defined.items():
                self.scores[i] = len(piece.encode()) * max([0.0, *normal]) - 0.1
        #: Score of a character that no piece covers.
        self.floor = min(normal, default=0.0) - 10.0
        #: User-defined pieces at which a text is cut, the longest first, and their ids.
        self.cuts = {p: i for p, i in defined.items() if p} if self.kind == BPE else {}
        self.cut_at = re.compile("|".join(map(re.escape, sorted(self.cuts, key=len, reverse=True)))) if self.cuts else None
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.max_piece = max(map(len, self.ids), default=1)
        #: Pairs of characters that are neighbours in some piece; elsewhere all paths have a boundary.
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: A search that starts anew at each run of spaces is right if no piece has one inside.
        self.spaces_lead = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def fallback(self, char: str) -> tuple[int, ...]:
        """Ids of a character that no piece covers."""
        if self.byte_fallback and len(self.byte_ids) == 256:
            return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,)


#: Marks of a position: no path yet, and one whose last character no piece covers.
UNREACHED, UNCOVERED = -2, -1


class StreamingViterbi:
    """Search over a text that arrives in parts: ``feed`` returns ids as they become final."""

    def __init__(self, model: PieceModel):
        self.model, self.unigram = model, model.kind == UNIGRAM
        self.allowed: dict[tuple[int, int], bool] = {}
        self.histories: dict[int, list[tuple[float, str, str]] | None] = {}
        self.floor = model.floor
        #: Pieces by their characters, one level of dictionaries a character; "" holds the id.
        self.tree: dict = {}
        for text, piece in model.ids.items():
            node = self.tree
            for char in text:
                node = node.setdefault(char, {})
            node[""] = piece
        self.reset()

    def reset(self) -> None:
        self.text, self.done = "", 0
        self.last, self.back, self.best = [UNCOVERED], [0], [0.0]

    # -- rules of the two kinds of model

    def history(self, piece: int) -> list[tuple[float, str, str]] | None:
        """How merging builds a piece from its characters: before each merge its score and the
        outermost symbols, then a last entry for the whole. None if merging ends elsewhere."""
        if piece not in self.histories:
            ids, scores, text = self.model.ids, self.model.scores, self.model.pieces[piece]
            parts, steps = list(text), []
            while len(parts) > 1:
                best, at = NEVER, -1
                for i in range(len(parts) - 1):
                    made = ids.get(parts[i] + parts[i + 1])
                    if made is not None and (at < 0 or scores[made] > best):
                        best, at = scores[made], i
                if at < 0:
                    break
                steps.append((best, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.histories[piece] = [*steps, (NEVER, text, text)] if len(parts) == 1 else None
        return self.histories[piece]

    def follows(self, one: int, two: int) -> bool:
        """Whether piece two may stand after piece one (-1: a start or an uncovered character).

        Both pieces are built side by side, the best-ranked merge first and the left one of equals;
        the two may stand together if no merge across their border ever comes first.
        """
        known = self.allowed.get((one, two))
        if known is None:
            if len(self.allowed) >= REMEMBERED:
                self.allowed.clear()
            known = self.allowed[one, two] = self._stay_apart(one, two)
        return known

    def _stay_apart(self, one: int, two: int) -> bool:
        right = self.history(two)
        if right is None or one < 0:
            return right is not None
        left, ids, scores, i, j = self.history(one), self.model.ids, self.model.scores, 0, 0
        while True:
            (score_left, _, end), (score_right, start, _) = left[i], right[j]
            across = ids.get(end + start)
            if across is not None and scores[across] > score_left and scores[across] >= score_right:
                return False
            if score_left == NEVER == score_right:
                return True
            if score_left >= score_right:
                i += 1
            else:
                j += 1

    # -- the search

    def _extend(self, upto: int) -> None:
        """Follow all pieces that start before a position."""
        text, last, back, best = self.text, self.last, self.back, self.best
        tree, longest, allowed, unigram = self.tree, self.model.max_piece, self.allowed, self.unigram
        grown = len(text) + 1 - len(last)
        last += [UNREACHED] * grown
        back += [0] * grown
        if unigram:
            best += [0.0] * grown
        for start in range(self.done, upto):
            end, before, node, single = start, last[start], tree, False
            for char in text[start : start + longest]:
                node = node.get(char)
                if node is None:
                    break
                end += 1
                piece = node.get("")
                if piece is None:
                    continue
                if unigram:
                    single = single or end == start + 1
                    score = best[start] + self.model.scores[piece]
                    if last[end] == UNREACHED or score > best[end]:
                        last[end], back[end], best[end] = piece, start, score
                elif last[end] == UNREACHED:
                    good = allowed.get((before, piece))
                    if self.follows(before, piece) if good is None else good:
                        last[end], back[end] = piece, start
            if last[start + 1] == UNREACHED or (unigram and not single and best[start] + self.floor > best[start + 1]):
                last[start + 1], back[start + 1] = UNCOVERED, start
                if unigram:
                    best[start + 1] = best[start] + self.floor
        self.done = max(self.done, upto)

    def _ids(self, upto: int) -> list[int]:
        """Ids of the path into a position."""
        parts, at, last, back = [], upto, self.last, self.back
        while at:
            piece = last[at]
            parts.append((piece,) if piece >= 0 else self.model.fallback(self.text[back[at] : at]))
            at = back[at]
        return list(chain.from_iterable(reversed(parts)))

    def _meet(self) -> int:
        """The last boundary on all surviving paths: those into positions not followed up yet."""
        alive = {i for i in range(self.done, len(self.last)) if i == self.done or self.last[i] != UNREACHED}
        while len(alive) > 1:
            farthest = max(alive)
            alive.discard(farthest)
            alive.add(self.back[farthest])
        return alive.pop()

    def _drop(self, upto: int) -> None:
        """Forget what lies before a committed boundary."""
        self.text, self.done, self.last = self.text[upto:], self.done - upto, self.last[upto:]
        self.back = [0, *(b - upto for b in self.back[upto + 1 :])]
        if self.unigram:
            base = self.best[upto]
            self.best = [b - base for b in self.best[upto:]]

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.model.max_piece
        for at in range(0, len(part), step):
            self.text += part[at : at + step]
            self._extend(max(self.done, len(self.text) - self.model.max_piece))
            if final := self._meet():
                out += self._ids(final)
                self._drop(final)
        return out

    def finish(self) -> list[int]:
        self._extend(len(self.text))
        out = self._ids(len(self.text))
        self.reset()
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of a text that is searched from its start to its end."""
        if len(text) > LONGEST_REMEMBERED:
            return self.feed(text) + self.finish()
        self.text = text
        return self.finish()


class _Words(dict):
    """Ids of words (without their leading space), searched when first asked for.

    Between two characters that are neighbours in no piece all paths meet, so a word is cut there
    and its parts, which recur far more often than whole words, are remembered too.
    """

    def __init__(self, search: StreamingViterbi, lead: str):
        super().__init__()
        self.search, self.lead = search, lead
        self.parts: dict[str, tuple[int, ...]] = {}

    def part(self, text: str) -> tuple[int, ...]:
        found = self.parts.get(text)
        if found is None:
            found = tuple(self.search.whole(text))
            if len(text) <= LONGEST_REMEMBERED:
                if len(self.parts) >= 2 * REMEMBERED:
                    self.parts.clear()
                self.parts[text] = found
        return found

    def __missing__(self, word: str) -> tuple[int, ...]:
        text, joined = self.lead + word, self.search.model.neighbours
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        if cuts:
            found = tuple(chain.from_iterable(self.part(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)))
        else:
            found = self.part(text)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one model; build one per worker."""

    def __init__(self, data: bytes):
        self.model = PieceModel(data)
        self.search = StreamingViterbi(self.model)
        self.words = _Words(self.search, SPACE)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.model.pieces, self.model.kinds, strict=True)
        ]

    def parts(self, text: str) -> Iterable[tuple[int, ...]]:
        """Groups of ids that make up the text's encoding, in order."""
        if self.model.squeeze:
            text = " ".join(w for w in text.split(" ") if w)
        if not text:
            return ()
        lead = SPACE if self.model.dummy_prefix else ""
        if self.model.cut_at is not None:
            found = self._between(lead + text.replace(" ", SPACE))
        elif lead and self.model.spaces_lead and "  " not in text and SPACE not in text and text[0] != " ":
            found = map(self.words.__getitem__, text.split(" "))
        else:
            found = (self.search.whole(lead + text.replace(" ", SPACE)),)
        return found if self.model.byte_fallback else self._joined(found)

    def _between(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of a text that is cut at user-defined pieces."""
        at = 0
        for m in self.model.cut_at.finditer(text):
            if m.start() > at:
                yield self.search.whole(text[at : m.start()])
            yield (self.model.cuts[m[0]],)
            at = m.end()
        if at < len(text):
            yield self.search.whole(text[at:])

    def _joined(self, groups: Iterable[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
        """groups with one unknown id for a run of them."""
        unknown, last = self.model.unknown, -1
        for group in groups:
            kept = [x for i, x in enumerate(group) if x != unknown or (group[i - 1] if i else last) != unknown]
            last = group[-1] if group else last
            yield tuple(kept)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text or "")))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text or "")))

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def model_bytes(path: str = MODEL_PATH) -> bytes:
    return Path(path).read_bytes()


_codecs: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """The worker's codec for a broadcast model; kept between batches and tasks."""
    data = shared.value
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


#: Characters of text that are turned into one Arrow batch of ids.
BATCH_CHARS = 4_000_000


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in parts of bounded text, so that outputs stay small whatever the texts' lengths."""
    values, texts, start, size = batch.column(column), [], 0, 0
    for i in range(batch.num_rows):
        texts.append(values[i].as_py())
        size += len(texts[-1] or "")
        if size >= BATCH_CHARS or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start), texts
            texts, start, size = [], i + 1, 0


def encode(docs: DataFrame, path: str = MODEL_PATH, text: str = "text", ids: str = "ids", keep: list[str] | None = None, check: str | None = None) -> DataFrame:
    """Add the ids (array<int>) of each text by the model at path.

    Null texts get null ids; empty texts get none. ``keep`` names the columns to carry along (all if
    unset); a column that has the output's name is replaced. With ``check``, a boolean column of that
    name tells whether decoding the ids gives the text back. Narrow: no shuffle, memory bounded by the
    search window, a fixed number of remembered words and one part of a batch.
    """
    out = [x for x in (ids, check) if x]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in out]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(check, T.BooleanType())] if check else []))
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    inner = docs.select(*kept, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for whole in batches:
            for batch, texts in _slices(whole, "__text"):
                offsets = np.zeros(len(texts) + 1, np.int32)
                flat, good = [], []
                for i, value in enumerate(texts):
                    found = codec.encode(value)
                    offsets[i + 1] = offsets[i] + len(found)
                    flat.append(np.array(found, np.int32))
                    if check:
                        good.append(None if value is None else codec.decode(found) == value)
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                mask = pa.array([x is None for x in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)
                columns = [batch.column(c) for c in kept] + [lists] + ([pa.array(good, pa.bool_())] if check else [])
                yield pa.RecordBatch.from_arrays(columns, names=kept + out)

    return inner.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL_PATH, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace or add the text column by decoding the ids; null ids give null, no ids an empty text, and
    an empty table an empty one."""
    kept = [c for c in encoded.columns if c != text]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(text, T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts = [codec.decode(x.as_py()) if x.is_valid else None for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=kept + [text])

    return encoded.select(*kept).mapInArrow(run, schema)


def encoded_lengths(docs: DataFrame, path: str = MODEL_PATH, text: str = "text", length: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Add the number of ids of each text (null and empty: 0) without building the ids."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != length]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(length, T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            sizes = [codec.count(x.as_py()) for x in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sizes, pa.int64())], names=kept + [length])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
