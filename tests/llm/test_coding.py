"""Operators 3, 7 and 10 against the libraries, and the Simple-8b coder by round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import sentencepiece_codec, token_counts, token_files


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=1200))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, offsets = token_files.pack(a)
    assert (token_files.unpack(words, offsets) == a).all()
    if len(offsets) > 1:
        assert (token_files.unpack(words, offsets, 1, 2) == a[token_files.BLOCK : 2 * token_files.BLOCK]).all()


def test_token_files(spark, docs, empty, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_files(docs, str(tmp_path / "t"), path, end_id=2)
    got, start = by_id(token_files.read_files(spark, str(tmp_path / "t"), with_ids=True)), 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        packed, r = np.array(ids, "<u4").tobytes(), got[i * 3]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids), zlib.crc32(packed), packed)
        start += len(ids)
    assert len(got) == len(texts)
    token_files.write_files(empty, str(tmp_path / "e"), path, end_id=2)
    assert token_files.read_files(spark, str(tmp_path / "e")).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "b"), (1, "z"), (1, "a"), (1, "a")], "doc_id long, text string")
    token_files.write_files(df, str(tmp_path / "t"), path, end_id=None)
    got = token_files.read_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1] and [r["start"] for r in got] == [0, 1, 2, 3]
    assert got[1]["ids_crc32"] == got[2]["ids_crc32"] != got[3]["ids_crc32"]


def test_capitals_before_combining_marks():
    """Marks that compose with the small letter only: the normalizer composes first, then folds case."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a", "The T\u0308 AND", "t\u0308 j\u030c", "PLAIN words"]
    got = token_files.encode_texts(path, [t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_refused(docs, tmp_path):
    with pytest.raises(ValueError):
        token_files.encode_texts(public_tokenizers.path("byte_bpe_50k.json"), [b"a"])
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("table", [0, 5, 1000])
def test_token_counts(docs, empty, texts, table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = by_id(token_counts.count_tokens(docs, path, limit=50, table=table))
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i * 3]["n_tokens"], got[i * 3]["n_bytes"], got[i * 3]["over_limit"]) == (n, len((t or "").encode()), n > 50)
    assert token_counts.count_tokens(empty, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u180eab.é日"), st.characters(exclude_categories=("Cs",))), max_size=60), max_size=5))
def test_pre_tokens_are_cut_at_white_space(texts):
    raw = [t.encode() for t in texts]
    for slice_bytes in (16, 1 << 19):
        old, token_counts.SLICE = token_counts.SLICE, slice_bytes
        try:
            found = [[] for _ in texts]
            for buf, ends, owners in token_counts.slices(raw):
                starts, places = token_counts.cut(buf, ends)
                assert (places == np.arange(len(buf)) - starts[np.searchsorted(starts, np.arange(len(buf)), "right") - 1]).all()
                for a, b, o in zip(starts.tolist(), [*starts[1:].tolist(), len(buf)], owners[np.searchsorted(ends, starts, "right")].tolist(), strict=True):
                    found[o].append(buf[a:b].tobytes().decode())
        finally:
            token_counts.SLICE = old
        assert found == [regex.findall(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+", t) for t in texts]


def test_text_ids_are_refused(spark, tmp_path):
    from logloom.llm import fingerprints

    df = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    for bad in (lambda: token_files.write_files(df, str(tmp_path / "f"), public_tokenizers.path("word_bpe_49k.json"), 2), lambda: fingerprints.edited_likeness(df)):
        with pytest.raises(ValueError, match="whole number"):
            bad()


def test_table_of_pre_tokens():
    pieces = [f" w{i}".encode() for i in range(2000)] + ["\u2003é".encode(), b"\n\n"]
    table = token_counts.Table(pieces, np.arange(len(pieces)) % 7)
    find = lambda p: table.find(np.frombuffer(p, np.uint8), *token_counts.cut(np.frombuffer(p, np.uint8), np.empty(0, np.int64))).tolist()
    for i, p in enumerate(pieces):
        assert find(p) == [i % 7]
    assert find(b" other") == [-1] and find(b"".join(pieces)) == [i % 7 for i in range(len(pieces))]
    table.bytes = table.bytes.copy()
    table.bytes[:] = 1  # as if other bytes had all these hashes
    assert find(b"".join(pieces)) == [-1] * len(pieces)


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_polynomials_take_for_equal(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [f"x {w} y z" for n in (1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n, "b", "a"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for table in (0, 100):
        got = by_id(token_counts.count_tokens(df, path, table=table))
        assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c")] * 3 + [(None, "x y")] * 2 + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for got in (token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")), sentencepiece_codec.encode_decode(df, public_tokenizers.path("piece_bpe_32k.model"))):
        assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(d) for d, _ in rows)


def test_sentencepiece(docs, empty, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(sentencepiece_codec.encode_decode(docs, path, with_ids=True))
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        r = got[i * 3]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_decode(empty, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tatheincro.,!<s>é"), st.characters(exclude_categories=("Cs",))), max_size=80))
def test_agenda_equals_library(text):
    m = sentencepiece_codec.model(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.frombuffer(m.encode([text])[0], "<u4").tolist() == m.library.encode(text)


def test_both_agendas():
    m = sentencepiece_codec.model(public_tokenizers.path("piece_bpe_32k.model"))
    for word in ("▁international", "▁aaaaaaaaaa", "ththththth", "▁▁▁▁▁", "é́x", "internationalisation" * 9):
        assert m.merge_short(word) == m.merge_long(word)
