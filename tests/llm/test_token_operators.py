import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from leafmill.llm import packing, token_files, tokens
from tests.llm.rows import documents, nothing

tokenizers_dir = pytest.importorskip("public_tokenizers")
PATH = tokenizers_dir.path("byte_bpe_50k.json")


def whole(texts, path=PATH):
    """Expected ids, from a bare tokenizer."""
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def cached(texts, path=PATH):
    out = []
    for ids, pointers in tokens.Encoder.of(path).encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(pointers[:-1], pointers[1:])]
    return out


def test_cached_ids_are_the_library_s():
    odd = ["", None, "it's don'tell 'll ''s ! 's x's 'S 'T're'm'd", "a  b\n c \n\n  d\t\te ", " '", "日本語 text", "<|endoftext|> x", "a\u00a0 b\u0085c", "'" * 9, "x" * 5000]
    rng = random.Random(1)
    made = ["".join(rng.choice(" \n\t'stremvld12éÀß!.% ıABC\r") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert cached(odd + made) == whole(odd + made)


def test_names_of_added_tokens_are_coded_as_the_library_codes_them():
    texts = ["<|endoftext|>", "a<|endoftext|> b", "plain", "<|endoftext|", " <|endoftext|><|endoftext|>\n"]
    assert cached(texts) == whole(texts)
    assert any(i == Tokenizer.from_file(PATH).token_to_id("<|endoftext|>") for i in cached(texts)[0])


def test_another_kind_of_tokenizer_is_asked_as_a_whole():
    path = tokenizers_dir.path("word_bpe_49k.json")
    texts = ["Hello  World's", "", "a b"]
    assert cached(texts, path) == whole(texts, path)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.sampled_from([16, 64]))
def test_every_token_is_in_one_piece_and_offsets_have_no_gap(sizes, window):
    plan = packing.plan(sizes, window, 0.05)
    covered = [[] for _ in sizes]
    for sequence in plan:
        assert 0 < sum(n for _, _, n in sequence) <= window
        for d, at, n in sequence:
            covered[d].append((at, n))
    for size, pieces in zip(sizes, covered):
        end = 0
        for at, n in sorted(pieces):
            assert at == end and n > 0
            end += n
        assert end == size
    waste = sum(window - sum(n for _, _, n in s) for s in plan)
    assert waste <= 0.05 * window * len(plan) + window


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=40))
def test_best_fit_finds_the_tightest_window(lengths):
    room, wanted = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room[room.index(min(fits))] -= lengths[i]
        else:
            room.append(32 - lengths[i])
        wanted = sorted(room)
    got = packing.best_fit_decreasing(lengths, 32)
    assert sorted(32 - sum(lengths[i] for i in s) for s in got) == wanted


def test_packed_pieces_hold_the_documents_tokens(spark):
    docs = documents(spark)
    wanted = sorted(str(ids + [1]) for ids in whole([r.text for r in docs.collect()]))
    rows = packing.pack(docs, tokenizer=PATH, window=64).collect()
    by_doc: dict = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.padded_length in (64, r.length)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    got = sorted(str([x for _, ids in sorted(p) for x in ids]) for k, p in by_doc.items() if k[0] != 10)
    assert got == [w for w in wanted if w != str(whole(["a b"])[0] + [1])]
    assert len(by_doc[(10, len(whole(["a b"])[0]) + 1)]) >= 2
    assert packing.pack(nothing(spark), tokenizer=PATH).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=3000))
def test_random_access_to_codes(ids):
    raw = token_files.file_bytes(np.array([5]), np.array([False]), np.array([0, len(ids)]), np.array(ids, dtype=np.uint32))
    reader = token_files.Reader(raw)
    assert reader.tokens(0, len(ids)).tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1} if ids else ():
        assert reader.token(i) == ids[i]
    a, b = len(ids) // 3, 2 * len(ids) // 3
    assert reader.tokens(a, b).tolist() == ids[a:b]


def test_files_are_read_back_in_key_order(spark, tmp_path):
    docs = documents(spark)
    files = token_files.write(docs, str(tmp_path / "t"), tokenizer=PATH)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, files).collect())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    wanted, start = [], 0
    for r, ids in zip(rows, whole([r.text for r in rows])):
        own = np.array([*ids, 2], "<u4")
        wanted.append(((r.doc_id is not None, r.doc_id or 0), start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == sorted(wanted)
    small = token_files.write(docs, str(tmp_path / "small"), tokenizer=PATH, file_tokens=3)
    cut = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, small).collect())
    assert len(small) >= len(files) and cut == got
    again = token_files.write(nothing(spark), str(tmp_path / "n"), tokenizer=PATH)
    assert again == [] and token_files.read(spark, again).count() == 0
