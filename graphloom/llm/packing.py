"""Operator 9, packing: concatenate and cut.

Each document becomes its token ids and an end id; all documents in a row are
cut into windows of fixed size. Two passes: the first tokenises, writes the ids
to the shared folder and notes the tokens before each document within its task;
prefix sums over the tasks' totals then give every document its global offset,
and the second pass cuts it where windows end. Nothing is shuffled: one total
for each task moves. Only the very last window can need padding.

A text is tokenised word by word: the tokenizer never joins what white space
parts, nor a letter and a mark, so each different word is encoded once. Words of plain
letters, nearly all, go to the tokenizer's model many at once: it would only make
them small and leave them whole before.

Defined results: a null or empty text is the end id alone; a null doc_id is
carried along; repeated rows are packed each; an empty table gives an empty
result; a text of any length is cut into as many pieces as it
needs (and once more every _IDS ids); other
columns are dropped, whatever their names. Ties do not arise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bytetext
from graphloom.llm.common import read, written


#: Bytes of text that are tokenised at once: the more, the fewer words are looked up twice.
_PIECE = 2_000_000
#: Bits of the number of slots of the encoder's table.
_SLOTS = 20
#: Token ids that one row holds at most.
_IDS = 1 << 22
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII marks that the tokenizer always parts from ASCII letters. Left out: the apostrophe, which begins contractions, and < | >, which are in its special tokens.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True
#: Words of letters that nothing composes and that the tokenizer leaves whole, after making them small.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: How byte-level tokenizers write each byte: printable Latin-1 characters stand for themselves, the others follow U+00FF; here a space parts words.
_SHOWN = np.arange(256, dtype="<u2")
_HIDDEN = [b for b in range(256) if not (33 <= b < 127 or b >= 161 and b != 173)]
_SHOWN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_SHOWN[32] = 32


def _runs(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all words in a row, how many each text has): n ids from begin on are a word's, first is the first word of each text and the end."""
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[first])


class WordEncoder:
    """Token ids of batches of texts, by a table of the words met so far that is emptied when it grows large.

    A word of up to seven bytes is its own key. A longer one is found by its hash and must be that word by its bytes; texts in
    which it isn't are encoded without the table.
    """

    hashes = staticmethod(bytetext.words_hash)

    def __init__(self, tokenizer: str, most_words: int = 1_000_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        # plain words need the tokenizer's model alone, whose marks of ends of words tell them apart
        self.model, mark = Tokenizer(self.tokenizer.model), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ids = self.tokenizer.get_vocab()
        self.last = np.zeros(max(ids.values(), default=0) + 1, bool)
        self.last[[i for token, i in ids.items() if mark and token.endswith(mark)]] = True
        letters = [chr(c) for c in range(256) if _PLAIN(chr(c))]
        (flat, ends), (same, size) = (of([*letters, "".join(letters)]) for of in (self._of_model, self._of_all))
        self.simple = np.array_equal(flat, same) and np.array_equal(ends, np.cumsum(size))  # else it is a tokenizer of another kind
        self.most = most_words
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.known: dict[int, int] = {}  # the row of each key
        self.slots = np.full(1 << _SLOTS, -1, np.int32)  # and of the key that was last met in each slot: most words are found there
        self.text, self.since, self.until = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the bytes of each word

    def _of_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all plain words in a row, where each word's end)."""
        parts = [np.zeros(0, np.uint32)]
        for i in range(0, len(words), 500):
            letters = _SHOWN[np.frombuffer(" ".join(words[i : i + 500]).lower().encode(), np.uint8)].tobytes().decode("utf-16-le")
            parts.append(np.array(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(parts)
        return flat, np.flatnonzero(self.last[flat]) + 1

    def _of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has)."""
        ids: list[int] = []
        size = []
        for i in range(0, len(words), 5_000):
            for e in self.tokenizer.encode_batch_fast(words[i : i + 5_000], add_special_tokens=False):
                one = e.ids
                ids += one
                size.append(len(one))
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the first of each word, how many it has)."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.array([self.simple and _PLAIN(t) is not None for t in texts], bool)
        flat, ends = self._of_model([texts[i] for i in np.flatnonzero(plain).tolist()])
        others, n = self._of_all([texts[i] for i in np.flatnonzero(~plain).tolist()])
        size = np.zeros(len(texts), np.int64)
        size[plain], size[~plain] = np.diff(ends, prepend=0), n
        begin = np.zeros(len(texts), np.int64)
        begin[plain], begin[~plain] = ends - size[plain], len(flat) + np.cumsum(n) - n
        return np.concatenate([flat, others]), begin, size

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, begin, size = self._ids(words)
        long = np.array([len(w) for w in words], np.int64)
        since = len(self.text) + np.cumsum(long) - long
        self.begin = np.concatenate([self.begin, len(self.flat) + begin])
        self.keys, self.size = np.concatenate([self.keys, keys]), np.concatenate([self.size, size])
        self.since, self.until = np.concatenate([self.since, since]), np.concatenate([self.until, since + long])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(words), np.uint8)])
        self.flat = np.concatenate([self.flat, ids])
        self.known.update(zip(keys.tolist(), range(len(self.keys) - len(keys), len(self.keys))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        starts, ends, first = bytetext.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        if b"<|" not in raw:  # the tokenizer makes all letters small, but not before it looks for its special tokens
            data = bytetext.LOWER[data]
            raw = data.tobytes()
        letter, mark = _LETTER[data], _MARK[data]
        cuts = np.flatnonzero(letter[:-1] & mark[1:] | mark[:-1] & letter[1:]) + 1
        begins, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        for edge, own in ((begins, starts), (stops, ends)):
            edge[own] = True
            edge[cuts] = True  # where two texts meet at a cut, a word ends and a word begins there anyway
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        first = np.searchsorted(starts, offsets)
        h, long = bytetext.word_keys(data, starts, ends, self.hashes)
        if len(self.keys) > self.most:
            self._forget()
        slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        row = self.slots[slot].astype(np.int64)
        missed = np.flatnonzero(self.keys[row] != h) if len(self.keys) else np.arange(len(h))
        if len(missed):
            different, at, which = np.unique(h[missed], return_index=True, return_inverse=True)
            found = np.array([self.known.get(k, -1) for k in different.tolist()], np.int64)
            new = np.flatnonzero(found < 0)
            if len(new):
                found[new] = len(self.keys) + np.arange(len(new))
                first_met = missed[at[new]]
                self._learn(different[new], [raw[a:b] for a, b in zip(starts[first_met].tolist(), ends[first_met].tolist(), strict=True)])
            self.slots[slot[missed[at]]] = found
            row[missed] = found[which]
        there = row[long]
        if not bytetext.same_bytes(data, starts[long], ends[long], self.text, self.since[there], self.until[there]).all():
            return self._plain(raw, starts, ends, first)
        return _runs(self.flat, self.begin[row], self.size[row], first)

    def _plain(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, without the table: for texts with words that share a hash."""
        return _runs(*self._ids([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), first)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", most: int = _IDS) -> DataFrame:
    """(part, before, key, ids, n): ids as little-endian 32-bit numbers; before counts the ids before in the same part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(1)), _PIECE):
                ids, n = encoder.encode(data, offsets)
                last = np.cumsum(n + 1) - 1
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                own = np.ones(len(out), bool)
                own[last] = False
                out[own] = ids
                start = np.concatenate([[0], last + 1])
                # a row holds so many ids at most: a long document is several rows
                rows = np.maximum(1, -(-(n + 1) // most))
                of = np.repeat(np.arange(j - i), rows)
                since = (np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)) * most
                edges = np.append(start[of] + since, start[-1])
                for a in range(0, len(of), len(of) if j - i > 1 else 1):
                    b = len(of) if j - i > 1 else a + 1
                    size = ((edges[a : b + 1] - edges[a]) * 4).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(size), pa.py_buffer(out[edges[a] : edges[b]].astype("<u4"))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b - a, part), pa.int32()), pa.array(start[of[a:b]] + before), batch.column(0).take(pa.array(of[a:b] + i)), packed, pa.array(n[of[a:b]] + 1), pa.array(since[a:b])],
                        ["part", "before", "key", "ids", "n", "start"],
                    )
                before += int(start[-1])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"part int, before long, key {kind}, ids binary, n long, start long")


def pack(docs: DataFrame, size: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, key: str = "doc_id", text: str = "text", most: int = _IDS) -> DataFrame:
    """One row for each piece: key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset."""
    held = written(tokenised(docs, tokenizer, end_id, key, text, most), "tokens")
    totals = held.where("start = 0").groupBy("part").agg(F.sum("n").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the first pass
    totals = totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("shift"))
    placed = held.join(F.broadcast(totals), "part").select("key", "ids", "n", (F.col("before") + F.col("shift")).alias("place"), "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            column, total, place, since = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, ids in enumerate(batch.column(1)):
                view = memoryview(ids.as_buffer())
                n, at, done = len(view) // 4, place[i] + since[i], 0
                while done < n:
                    offset = (at + done) % size
                    length = min(size - offset, n - done)
                    piece = view[4 * done : 4 * (done + length)]
                    for held_, x in zip(rows, (i, since[i] + done, length, bytes(piece), zlib.crc32(piece), total[i], (at + done) // size, offset), strict=True):
                        held_.append(x)
                    done += length
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([column.take(made[0]), *made[1:]], [key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return placed.mapInArrow(cut, f"{key} {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")
