import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandloom.llm import sentencepiece_codec as S
from strandloom.llm import token_counts as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def _texts():
    rng = random.Random(7)
    letters = "abcdefghijklmnop  .,#\n\té漢▁🎉"
    fixed = ["", " ", "  a  b ", "a" * 700, "=-=" * 90, "<s>x</s> <0x41>", "the theory of everything", " lead", "\0\x01"]
    return fixed + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(60)]


def test_ids_equal_the_library():
    codec, library = S.Codec(S.model_bytes()), sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)
    for text in _texts():
        assert codec.encode(text) == library.encode(text), text
        assert codec.count(text) == len(library.encode(text))
        if S.SPACE not in text:
            assert codec.decode(codec.encode(text)) == text


def test_stream_in_parts_commits_early_and_agrees():
    search = S.StreamingViterbi(S.PieceModel(S.model_bytes()))
    text = S.SPACE + S.SPACE.join(["streaming", "search", "over", "parts"] * 200)
    whole = search.whole(text)
    ids, held = [], 0
    for at in range(0, len(text), 7):
        ids += search.feed(text[at : at + 7])
        held = max(held, len(search.text))
    assert ids + search.finish() == whole
    assert held < 200  # the window, not the text


def test_unigram_models_take_the_best_path():
    model = S.PieceModel(b"")
    model.pieces, model.scores, model.kinds = ["a", "b", "ab", "aba", "ba"], [-2.0, -2.0, -2.5, -9.0, -2.2], [1] * 5
    model.ids, model.kind = {p: i for i, p in enumerate(model.pieces)}, S.UNIGRAM
    model.max_piece, model.neighbours, model.floor = 3, {"ab", "ba"}, -19.0
    search = S.StreamingViterbi(model)

    def brute(text):
        best = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            options = [(best[s][0] + model.scores[model.ids[text[s:end]]], best[s][1] + [model.ids[text[s:end]]]) for s in range(end) if text[s:end] in model.ids]
            best[end] = max(options, key=lambda o: o[0])
        return best[len(text)]

    for text in ("ab", "aba", "abab", "bbaab", "ab" * 60):
        score, _ = brute(text)
        got = search.whole(text)
        assert "".join(model.pieces[i] for i in got) == text
        assert abs(sum(model.scores[i] for i in got) - score) < 1e-9


def test_operator_on_edge_rows(spark):
    rows = [(1, "two words", "en", "s", 9, "clash"), (1, "two words", "en", "s", 9, "clash"), (None, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, "y" * 30_000, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    out = S.encode(docs, check="same")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "same"]
    got = out.collect()
    assert got[0].ids == got[1].ids and got[0].same
    assert got[2].ids is None and got[2].same is None
    assert got[3].ids == [] and got[4].same
    back = S.decode(out.drop("text")).collect()
    assert [r.text for r in back] == [r[1] for r in rows]
    assert S.encode(docs.limit(0)).collect() == []


def test_counts_against_brute_force(spark):
    texts = ["a b c", "a b c", None, "", "word " * 50, "longer text with words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lengths = [len(S.Codec(S.model_bytes()).encode(t)) for t in texts]
    got = {r.n_tokens: r for r in C.token_counts(docs).collect()}
    assert set(got) == set(lengths)
    for n, row in got.items():
        assert row.n_docs == lengths.count(n)
        assert row.docs_ge == sum(x >= n for x in lengths)
        assert row.tokens_ge == sum(x for x in lengths if x >= n)
        assert row.truncated_total == sum(min(x, n) for x in lengths)
        assert abs(row.docs_share_le - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    sums = C.token_counts(docs)
    for row in C.truncated_totals(sums, [0, 2, 5, 1000]).collect():
        assert row.total == sum(min(x, row.context) for x in lengths)
    assert C.quantiles(sums, [0.5]).first().n_tokens == sorted(lengths)[2]
    assert C.token_counts(docs.filter(F.lit(False))).collect() == []


def test_suffix_sums_across_blocks(spark):
    hist = spark.createDataFrame([(0, 3), (1023, 2), (1024, 1), (5000, 4)], "n_tokens long, n_docs long")
    got = {r.n_tokens: (r.docs_ge, r.tokens_ge) for r in C.suffix_sums(hist).collect()}
    assert got == {0: (10, 2046 + 1024 + 20000), 1023: (7, 2046 + 1024 + 20000), 1024: (5, 21024), 5000: (4, 20000)}


def _message(*fields):
    """A protocol-buffer message of (number, int, float, text or message) fields."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            key, left = number << 3, value
            out += bytes([key & 127 | 128, key >> 7]) if key > 127 else bytes([key])
            while left > 127:
                out, left = out + bytes([left & 127 | 128]), left >> 7
            out += bytes([left])
        else:
            body = value.encode() if isinstance(value, str) else value
            size = len(body)
            out += bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + body
    return out


def _model(kind, pieces, defined=(), prefix=1, squeeze=1, fallback=0):
    """A model file of given pieces and scores; nothing is trained."""
    rows = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL), *[(p, 0.0, S.USER_DEFINED) for p in defined]]
    rows += [(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)] if fallback else []
    rows += [(p, x, S.NORMAL) for p, x in pieces]
    body = b"".join(_message((1, _message((1, p), (2, x), (3, k)))) for p, x, k in rows)
    return body + _message((2, _message((3, kind), (35, fallback)))) + _message((3, _message((1, "identity"), (3, prefix), (4, squeeze), (5, 1))))


BPE_PIECES = [(p, -float(i)) for i, p in enumerate(["ab", "in", "\u2581in", "abc", "\u2581a", "bc", "\u2581ab", "ing", "\u2581", "a", "b", "c", "d", "i", "n", "g", "s", "e", "p"])]
UNIGRAM_PIECES = [("\u2581", -2.1), ("a", -3.0), ("b", -3.3), ("ab", -4.1), ("abc", -5.2), ("c", -4.0), ("\u2581ab", -4.4), ("in", -4.7), ("ing", -5.6), ("i", -3.9), ("n", -4.2), ("\u2581in", -5.0)]


def test_small_models_equal_the_library():
    """User-defined pieces, runs of unknown characters, byte fallback, with and without prefix and squeezing."""
    rng = random.Random(12)
    defined = ("<sep>", "<se", "abin", "\u2581<x>", "é")
    texts = ["a<sep>b again", "<sep>", "zzz", "a zz z b", "abinabin ab in", "x <x> <x>", "éé é", "漢字 ab", " ", "ab<se<sep>ing"]
    texts += ["".join(rng.choices(["a", "b", "c", "in", "ing", " ", "  ", "z", "漢", "é", "<sep>", "<se", "abin", "<x>"], k=rng.randint(1, 60))) for _ in range(150)]
    for kind, pieces in ((S.BPE, BPE_PIECES), (S.UNIGRAM, UNIGRAM_PIECES)):
        for own in ((), defined):
            for prefix, squeeze, fallback in ((1, 1, 0), (0, 0, 0), (1, 0, 1), (0, 1, 1)):
                data = _model(kind, pieces, own, prefix, squeeze, fallback)
                library = sentencepiece.SentencePieceProcessor(model_proto=data)
                codec = S.Codec(data)
                for text in texts:
                    assert codec.encode(text) == library.encode(text), (kind, own, prefix, squeeze, fallback, text)
                    assert codec.count(text) == len(codec.encode(text))


def test_models_that_are_refused():
    with pytest.raises(ValueError, match="unused"):
        S.Codec(_model(S.BPE, BPE_PIECES) + _message((1, _message((1, "q"), (2, -30.0), (3, S.UNUSED)))))
    with pytest.raises(ValueError, match="character map"):
        S.Codec(_message((3, _message((2, b"xx")))))


def test_counts_of_long_texts_clashing_columns_and_no_rows(spark):
    texts = ["long text " * 60_000, "x" * 400_000, "x" * 400_000, "short", None]
    docs = spark.createDataFrame([(i, t, 5, 6, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_docs int, docs_ge string")
    codec = S.Codec(S.model_bytes())
    lengths = [codec.count(t) for t in texts]
    got = {r.n_tokens: r.n_docs for r in C.token_counts(docs).collect()}
    assert got == {n: lengths.count(n) for n in lengths}
    none = C.token_counts(docs.limit(0))
    assert [tuple(r) for r in C.truncated_totals(none, [7]).collect()] == [(7, 0)] and C.quantiles(none, [0.5]).collect() == []
