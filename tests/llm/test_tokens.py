import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from attesta.llm import packing, rans
from attesta.llm._arrow import text_slices
from attesta.llm.tokenize import WordTokenizer, default_path


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_path())


def test_same_ids_as_the_library(spark, whole):
    own = WordTokenizer(default_path())
    assert own.short
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "don't STOP we'll'S ''s 's", "a1b22 3.5%", "É ÀÏ ß ÿ ×÷", "x <|endoftext|> y", "x <|EndOfText|> y <|", "é   漢字 \U0001f600", "\x0b\x0c\r\n tab\t", "Straße İstanbul ΑΣ", "µ ª"]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_slices_give_the_librarys_ids(spark, whole):
    """Words found by bytes, over several texts at once, and words asked for once a slice."""
    own = WordTokenizer(default_path())
    texts = ["", " ", "don't STOP we'll'S ''s 's", "rock 'n' roll", "a1b22 3.5%", "É ÀÏ ß ÿ ×÷", "Àé1Ñ-ñ.", "x <|endoftext|> y", "a < | b <|", "é   漢字 \U0001f600", "\x0b\x0c\r\n tab\t", "Straße İstanbul ΑΣ", "µ ª", "a\x7fb\x00c", "end'", "s it", None, "Z", "\u00a0x\u2003y", "e\u0301"]
    rng = np.random.default_rng(8)
    signs = list("aBz09 \t\n.,'<|-_ÀñßÿÇ") + ["'s", "'LL", "×", "漢", "  "]
    texts += ["".join(rng.choice(signs[: len(signs) - 5 * (k % 2)], rng.integers(0, 30))) for k in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for limit in (50, 1 << 20):
        got = [x for _, _, data, offsets in text_slices(pa.array(texts), limit) for x in own.ids_of_slice(data, offsets)]
        assert len(got) == len(texts)
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text[:80]


def test_words_met_again_stay(whole):
    """However many other words pass through a small cache, and with the library's ids all along."""
    own, asked = WordTokenizer(default_path(), 8), []
    model = own.words.model
    own.words.model = SimpleNamespace(tokenize=lambda word: asked.append(word) or model.tokenize(word))
    for k in range(60):
        text = f"often {'abcdefghijkl'[k % 12] * (k // 12 + 1)}q é{'uvwxyz'[k % 6]}"
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(own.words) + len(own.words.older) <= 8
    assert asked.count("often") == 1 and len(asked) > 60


def test_packing_is_exact(spark, documents, whole):
    got = packing.pack(documents, window=512).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    stream = {}
    for d in documents.collect():
        ids = whole.encode(d.text, add_special_tokens=False).ids + [2]
        own = sorted(pieces[d.doc_id], key=lambda r: r.start)
        assert [i for r in own for i in np.frombuffer(bytes(r.ids), "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 for r in own) and [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        for r in own:
            stream.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    assert sorted(stream) == list(range(len(stream)))
    for k, parts in stream.items():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts]])[:-1])
        filled = sum(p[1] for p in parts)
        assert filled == 512 or (k == len(stream) - 1 and filled < 512)
        assert parts[0][2] == (filled if filled & (filled - 1) == 0 else 512)


def test_rans_round_trip_and_checkpoints():
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(0, 49000, 3000))
    counts = (1e6 / np.arange(1, len(ids) + 1)).astype(np.int64) + 1
    table = rans.Table.scaled(ids, counts)
    assert int(table.freq.sum()) == 1 << rans.BITS and table.freq.min() >= 1
    for n in (1, 511, 512, 513, 200_000):
        data = rng.choice(ids, n, p=counts / counts.sum()).astype(np.uint32)
        payload = rans.encode_block(data, [7, None], np.array([n - 1, 1]), table)
        block = rans.Block(payload, table)
        assert np.array_equal(block.decode(), data) and block.doc_ids == [7, None]
        width = rans.CHECK_STEPS * rans.LANES
        for k in range(len(block.states)):
            assert np.array_equal(block.decode(k, 1), data[k * width : (k + 1) * width])
    assert len(payload) < 0.9 * 2 * n
    damaged = bytearray(payload)
    damaged[-5] ^= 1
    with pytest.raises(ValueError):
        rans.Block(bytes(damaged), table)


def test_one_symbol_table():
    table = rans.Table.scaled(np.array([5]), np.array([10]))
    data = np.full(1000, 5, np.uint32)
    assert np.array_equal(rans.Block(rans.encode_block(data, [1], np.array([1000]), table), table).decode(), data)


def test_token_files(spark, documents, whole, tmp_path):
    rans.write_token_files(documents, f"file://{tmp_path}/f")
    got = rans.read_token_files(spark, f"file://{tmp_path}/f").collect()
    assert len(got) == documents.count()
    at = 0
    for d, r in zip(sorted(documents.collect(), key=lambda d: d.doc_id), sorted(got, key=lambda r: r.start)):
        ids = whole.encode(d.text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_awkward_rows(spark, awkward):
    n = awkward.count()
    files = rans.token_files(awkward).collect()
    assert len(files) == n and [r.n_tokens for r in files if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    order = [r.doc_id for r in sorted(files, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    packed = packing.pack(awkward).collect()
    assert sum(r.length for r in packed) == sum(r.n_tokens for r in files)
    assert rans.token_files(awkward.limit(0)).count() == 0 and packing.pack(awkward.limit(0)).count() == 0
