"""Encoding, counts, packing and token files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import encode, packing, token_files
from lectern.llm.queries import vocabulary
from lectern.llm.token_count import token_counts

PATH = vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts, path=PATH):
    return [i.tolist() for _, ids in encode.encode(pa.array(texts, pa.string()), path) for i in ids]


def test_ids_are_those_of_the_library_on_hostile_texts(library):
    rng = random.Random(0)
    parts = ["a", "b ", "  ", "\n", "\n\n", " ", "the", "\t", " ", "é", "1", "'s", "<|endoftext|>", "\x1c", "\x00", "\x01", "　", "​", "!!", "\r\n", "x.", " \n", "日本", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    assert ours(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_are_those_of_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    assert ours([text])[0] == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_it_is_safe(library):
    rng = random.Random(1)
    text = "\t" + "".join(rng.choices(["word ", "other, ", "und\n", "x" * 50, "  "], k=400_000))
    run = encode.encoder(PATH)
    assert len(run.cut(text)) > 1
    assert ours([text]) == library([text])
    assert run.cut("x" * 3_000_000) == ["x" * 3_000_000]


def test_memory_of_pieces_is_bounded(library, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 50)
    run = encode.JsonEncoder(PATH)
    texts = [f"word{i} other{i % 7} " + "y" * (i % 90) for i in range(300)]
    got = [x.tolist() for k in range(0, 300, 20) for x in run(pa.array(texts[k : k + 20]))]
    assert got == library(texts)
    assert len(run.memory.new) + len(run.memory.old) <= 2 * (50 + 60) and all(len(w) <= encode.LONGEST for w in {**run.memory.new, **run.memory.old})
    assert run.count(pa.array(texts)).tolist() == [len(x) for x in got]


def test_runs_are_balanced_by_bytes():
    texts = pa.array(["x" * n for n in (5, 5, 100, 1, 1, 1)])
    assert list(encode.runs(texts, 10)) == [(0, 2), (2, 1), (3, 3)]


def test_sentencepiece_counts(tiny):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts(tiny.limit(30), path).collect()}
    assert got and all(n == len(model.encode(r.text)) for r in tiny.limit(30).collect() if (n := got[r.doc_id]) is not None)


def test_counts(edge, empty, tiny, library):
    rows = tiny.select("doc_id", "text").collect()
    want = {r.doc_id: len(i) for r, i in zip(rows, library([r.text for r in rows]), strict=True)}
    got = token_counts(tiny, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len(r.text.encode()) for r in rows}
    at_edge = token_counts(edge, PATH).collect()
    assert len(at_edge) == 11 and sum(r.n_tokens == 0 for r in at_edge) == 3
    assert token_counts(empty, PATH).count() == 0


def check_packing(rows, ids, room=1024, end=2):
    """Every id of every document is in one piece, pieces lie in sequences without gap."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    for d, pieces in docs.items():
        whole, at = np.array([*ids[d], end], "<u4"), 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and (k == 0 or r.length == room)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    return len(by_seq)


def test_packing(tiny, edge, empty, library):
    rows = tiny.select("doc_id", "text").collect()
    ids = {r.doc_id: i for r, i in zip(rows, library([r.text for r in rows]), strict=True)}
    used = check_packing(packing.packed(tiny, PATH).collect(), ids)
    least = -(-sum(len(i) + 1 for i in ids.values()) // 1024)
    assert used <= least * 1.02 + 1
    got = packing.packed(edge, PATH).collect()
    assert sum(r.doc_id == 7 for r in got) == 2 and [r.length for r in got if r.doc_id == 3] == [1]
    assert sum(r.doc_id is None for r in got) == 2
    assert packing.packed(empty, PATH).count() == 0


def test_packing_with_ids(tiny):
    got = packing.packed(tiny.limit(20), PATH, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_placing_minimises_the_sum_of_squares(lengths):
    room = 32
    seq, offset = packing.pack(np.array(lengths, np.int64), room)
    fill, made = {}, 0
    for s, q, o in zip(lengths, seq.tolist(), offset.tolist(), strict=True):
        open_ = {k: room - v for k, v in fill.items() if v < room}

        def squares(gaps):
            count = {}
            for g in gaps:
                count[g] = count.get(g, 0) + (g > 0)
            return sum(v * v for v in count.values())

        options = {k: squares([*(g for j, g in open_.items() if j != k), open_[k] - s]) for k in open_ if open_[k] >= s}
        if options:
            assert options[q] == min(options.values())
        else:
            assert q == made
        made = max(made, q + 1)
        assert o == fill.get(q, 0)
        fill[q] = o + s
        assert fill[q] <= room


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900))
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    assert token_files.ids_of(*token_files.blocks(x), len(x)).tolist() == ids


def test_width_is_a_percentile_and_the_rest_are_exceptions():
    x = np.array([7 + i % 4 for i in range(256)], np.uint32)
    x[5] = 50_000
    starts, data = token_files.blocks(x)
    assert data[4] == 2 and int(data[6]) == 1 and int(starts[-1]) == 8 + 64 + 6
    assert token_files.ids_of(starts, data, 256).tolist() == x.tolist()


def test_file_round_trip():
    ids = [np.array(x, np.uint32) for x in ([1, 2, 3], [], list(range(1000)))]
    got = token_files.load(token_files.dump([5, None, 7], ids))
    assert got[0] == [5, None, 7] and [x.tolist() for x in got[1]] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        token_files.load(b"something else entirely, not a file")


def test_token_files(tiny, edge, empty, library):
    rows = sorted(tiny.select("doc_id", "text").collect())
    want, start = {}, 0
    for r, i in zip(rows, library([r.text for r in rows]), strict=True):
        want[r.doc_id] = (start, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes()))
        start += len(i) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(tiny, PATH).collect()} == want
    got = sorted(token_files.round_trip(edge, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_files.round_trip(empty, PATH).count() == 0


def test_model_files_are_cut_where_it_is_safe():
    import public_tokenizers

    run = encode.ModelEncoder(str(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(2)
    text = "".join(rng.choices(["word ", "other, ", "und\n", "  ", "日本 ", "x-y ", "\t", "naïve "], k=3000))
    parts = run.cut(text, 100)
    assert run.cuts and len(parts) > 50
    assert [t for p in parts for t in run.model.encode(p)] == run.model.encode(text)
    assert run(pa.array([text, ""]))[0].tolist() == run.model.encode(text) and run.count(pa.array([text, ""])).tolist() == [len(run.model.encode(text)), 0]
