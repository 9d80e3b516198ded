"""Token ids of whole texts with the tokenizers library, words cached per Python worker.

The vocabulary file is a parameter and is read by each worker. ``WordTokenizer`` gives exactly the
ids of ``Tokenizer.encode(text, add_special_tokens=False)``. For a file whose pre-tokenizer deals a
text into words that are encoded on their own, the words of a slice of texts are found and
made distinct as byte arrays, the library's model is asked for each distinct word and the answer is
kept; texts with characters or strings outside the plain set go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from attesta.llm._arrow import text_slices

#: Words kept by a worker where its caller names no other number; those not met for long give way, which costs time only.
CACHE_WORDS = 150_000
#: Bytes of texts whose words are made distinct together; a longer text makes a slice of its own.
TEXT_BYTES = 1 << 21
#: Texts of these characters only take the short way: no normalisation but lower case, no marks.
_OUTSIDE = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\\s0-9a-zà-öø-ÿß]+")
#: The pre-tokenizer that the short way stands for (fixed values).
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: The same by bytes of UTF-8: kinds (white space, letter, digit, other), lower case of A-Z, bytes that no plain text holds.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x09, 0x0E), 0x20]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LATIN = 0xC3  # leads À to ÿ
_ODD = np.ones(256, bool)
_ODD[[*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0xC0), _LATIN]] = False
_CONTRACTS = np.zeros(256, bool)
_CONTRACTS[list(b"strvmldSTRVMLD")] = True


def default_path() -> str:
    """The 49k word vocabulary of the box."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids of words as bytes in two generations of ``room`` / 2 words: a word met again while in the older one moves to the newer one."""

    def __init__(self, model, chars, room: int, size: int):
        self.model, self.chars, self.room, self.older = model, chars, room, {}
        self.raw = [i.to_bytes(4, "little") for i in range(size)]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            mapped = word if word.isascii() else "".join([self.chars[c] if c in self.chars else c for c in word])
            ids = b"".join([self.raw[t.id] for t in self.model.tokenize(mapped)])
        if len(self) >= self.room // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordTokenizer:
    """ids(text) -> little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.short = split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True and kinds == ["NFC", "Replace", "Lowercase"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)", re.I)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = {chr(c): byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)} if self.short else {}
        self.words = _Words(self.whole.model, chars, cache_words, max(self.whole.get_vocab().values(), default=-1) + 1)

    def ids(self, text: str) -> bytes:
        if not self.short or _OUTSIDE.search(text) or ("<|" in text and self.special.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _PIECES.findall(text.lower())))

    def ids_of_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """``ids`` of every text of a slice as ``text_slices`` gives it."""
        texts, n = len(offsets) - 1, len(data)
        if not self.short or not n:
            return [self.ids(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        # texts for the other way: odd characters, apostrophes that may contract, what may be a special token
        odd = [np.flatnonzero(_ODD[data])]
        low = _LOWER[data]
        latin = np.flatnonzero(data == _LATIN)
        if len(latin):
            second = data[latin + 1]
            odd.append(latin[(second == 0x97) | (second == 0xB7)])  # × and ÷ are no letters
            low[latin + 1] = np.where(second < 0x9F, second + 32, second)
        for mark, after in ((0x27, _CONTRACTS), (0x3C, np.arange(256) == 0x7C)):
            at = np.flatnonzero(data[:-1] == mark)
            odd.append(at[after[data[at + 1]]])
        whole = np.unique(np.searchsorted(offsets, np.concatenate(odd), "right") - 1)
        # words: runs of one kind inside a text, digits one by one
        kind = _KIND[data]
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _DIGIT
        begins[offsets[:-1][offsets[:-1] < n]] = True
        solid = kind != _SPACE
        for k in whole.tolist():
            solid[offsets[k] : offsets[k + 1]] = False
        begins &= solid
        kept = low[solid]
        starts = np.r_[np.flatnonzero(begins[solid]), len(kept)].astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(kept)).dictionary_encode()
        # ids of the distinct words, then of all words in a row
        found = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = words.indices.to_numpy()
        n_ids = sizes[which]
        ends = np.cumsum(n_ids)
        ids = np.frombuffer(b"".join(found), "<u4")
        raw = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n_ids), n_ids) + np.arange(len(which) and ends[-1])].tobytes()
        cuts = (4 * np.r_[0, ends][np.searchsorted(np.flatnonzero(begins), offsets)]).tolist()
        out = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for k in whole.tolist():
            out[k] = self.ids(data[offsets[k] : offsets[k + 1]].tobytes().decode())
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    return WordTokenizer(path, cache_words)


def narrow_ids(path: str, end_id: int) -> bool:
    """Whether all ids fit 16 bits."""
    return max(tokenizer(path).whole.get_vocab_size() - 1, end_id) < 1 << 16


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 4, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, part, local_start, n, ids): ids of ``width`` bytes with ``end_id`` at the end, and the tokens before them in their partition.

    Null texts are empty (only the end id). Every row gives a row, null and repeated ids included.
    ``part`` and ``local_start`` hold for one run only: write the table before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, total = tokenizer(path, cache_words), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), TEXT_BYTES):
                ids = [x + end for x in own.ids_of_slice(data, offsets)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                if width == 2:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                starts = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "local_start", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, part int, local_start long, n long, ids binary")


def offsets_by_part(totals: DataFrame) -> DataFrame:
    """(part, base, total) from (part, tokens): exclusive prefix sums. One row per partition of the scan, so a single window is small."""
    return totals.selectExpr("part", "coalesce(sum(tokens) over (order by part rows between unbounded preceding and 1 preceding), 0) as base", "sum(tokens) over () as total")
