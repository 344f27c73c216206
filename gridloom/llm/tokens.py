"""Token ids of a byte-level BPE vocabulary, by the tokenizers library.

A worker keeps the ids of the words it has met (bounded), so that the library
encodes a word once and not each time it occurs. Words are what the vocabulary's
own pre-tokeniser makes: they are found here over the bytes of many texts at
once by character classes written out up to U+024F and looked up in a table by a
64-bit hash, with every hit compared by bytes, all in numpy. A text with a character beyond, or with an
apostrophe that may begin a contraction, goes to the library whole; so does a
word of more than LONGEST bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

from gridloom.llm.common import Stretches, WordStore

#: Words whose ids a worker keeps; beyond it the store is emptied.
WORDS_KEPT = 1 << 19
#: Bytes of a word that is kept.
LONGEST = 64
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

_BLANK, _LETTER, _NUMBER, _OTHER, _END = range(5)


def _class_of(c: str) -> int:
    return _BLANK if re.match("[\t-\r \x85\xa0]", c) else _NUMBER if re.match("[0-9\xb2\xb3\xb9\xbc-\xbe]", c) else _LETTER if c.isalpha() else _OTHER


#: Classes of the characters up to U+024F, and of the bytes below 128; 0xFF stands between texts.
_CLASS = np.array([_class_of(chr(i)) for i in range(0x250)], np.uint8)
_BYTE_CLASS = np.concatenate([_CLASS[:128], np.full(128, _OTHER, np.uint8)])
_BYTE_CLASS[0xFF] = _END
#: Beyond U+024F, or a contraction of the public pattern 's|'t|'re|'ve|'m|'ll|'d.
_APART = re.compile(rb"[\xca-\xff]|\xc9[\x90-\xbf]|'(?:[stmd]|re|ve|ll)").search
#: Words that the pre-tokeniser cuts again where they are strung together (a blank, then letters),
#: and those that it does where a line feed stands between (no blank but one before).
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN = re.compile(rf" [{_L}]+").fullmatch
_SOLID = re.compile(r" ?[^\t-\r \x85\xa0]+").fullmatch


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words start in texts that each end with 0xFF; the byte 0xFF is a word of its own.

    The public pattern, but for contractions: ' ?L+| ?N+| ?O+|S+(?!not S)|S+' for
    letters L, numbers N, blanks S and others O.
    """
    kind = _BYTE_CLASS[data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(two):
        kind[two] = kind[two + 1] = _CLASS[((data[two] & np.uint8(31)).astype(np.int64) << 6) | (data[two + 1] & np.uint8(63))]
    run = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _END)]))
    of = kind[run]
    start = np.zeros(len(data), bool)
    start[run] = True
    # the last blank before a word is a word by itself or, if it is a space, the word's start
    before = run[1:][(of[:-1] == _BLANK) & (of[1:] != _END)]
    last = before - 1
    last = last - ((data[last] & np.uint8(0xC0)) == 0x80)
    start[last] = True
    start[before[data[before - 1] == 32]] = False
    return np.flatnonzero(start)


class IdStore(WordStore):
    """Words with their ids, which lie in a pool."""

    def clear(self) -> None:
        super().clear()
        self.first, self.count, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def put(self, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """The ids of words that were added, one word's after the other's."""
        more = len(self) - len(self.first)
        self.first, self.count = np.concatenate([self.first, np.zeros(more, np.int32)]), np.concatenate([self.count, np.zeros(more, np.int32)])
        self.first[numbers], self.count[numbers] = len(self.pool) + np.cumsum(counts) - counts, counts
        self.pool = np.concatenate([self.pool, ids])

    def lay_out(self, number: np.ndarray, apart: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words by their numbers, one after the other, and where each ends); apart: those of words without number."""
        known = number >= 0
        count = np.zeros(len(number), np.int64)
        count[known] = self.count[number[known]]
        for i, x in apart.items():
            count[i] = len(x)
        reach = np.cumsum(count)
        begin, total = reach - count, int(reach[-1]) if len(reach) else 0
        source = np.full(len(number), 0, np.int64)
        source[known] = self.first[number[known]] - begin[known]
        source = np.repeat(source, count) + np.arange(total)
        for i, x in apart.items():
            source[begin[i] : reach[i]] = 0
        ids = self.pool[source] if len(self.pool) else np.zeros(total, np.uint32)
        for i, x in apart.items():
            ids[begin[i] : reach[i]] = x
        return ids, reach


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        #: Bytes that each id stands for: in a byte-level vocabulary one character is one byte.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        self.store = IdStore(kept)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _strung(self, words: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """Encode many words as one text and cut its ids by the bytes they stand for: counts, ids."""
        counts, ids = [], []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            got = self._whole(between.join(part))
            sizes = np.array([len(w.encode()) for w in part])
            ends = np.cumsum(sizes + len(between)) - len(between)
            reach = np.cumsum(self.width[got])
            stop, first = np.searchsorted(reach, ends) + 1, np.searchsorted(reach, ends - sizes, side="right")
            counts.append(stop - first)
            if between:
                keep = np.ones(len(got), bool)
                keep[stop[:-1]] = False
                got = got[keep]
            ids.append(got)
        return np.concatenate(counts), np.concatenate(ids)

    def _learn(self, numbers: np.ndarray, words: list[str]) -> None:
        kind = np.array([0 if _PLAIN(w) else 1 if _SOLID(w) else 2 for w in words])
        for k, between in ((0, ""), (1, "\n")):
            if len(at := np.flatnonzero(kind == k)):
                self.store.put(numbers[at], *self._strung([words[i] for i in at.tolist()], between))
        for i in np.flatnonzero(kind == 2).tolist():
            ids = self._whole(words[i])
            self.store.put(numbers[i : i + 1], np.array([len(ids)]), ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text."""
        out: list[bytes | None] = [self._whole(t.decode("utf-8", "replace")).astype("<u4").tobytes() if _APART(t) else None for t in texts]
        near = [i for i, x in enumerate(out) if x is None]
        if near:
            for i, ids in zip(near, self._encode_near([texts[i] for i in near])):
                out[i] = ids
        return out

    def _encode_near(self, texts: list[bytes]) -> list[bytes]:
        raw = b"\xff".join(texts) + b"\xff"
        data = np.frombuffer(raw, np.uint8)
        start = word_starts(data)
        end = np.concatenate([start[1:], [len(data)]])
        stops = data[start] == 0xFF
        long = end - start > LONGEST
        if len(self.store) > self.store.most:
            self.store.clear()
        number = np.full(len(start), -1, np.int32)
        rows = np.flatnonzero(~stops & ~long)
        before = len(self.store)
        number[rows], new = self.store.numbers(Stretches(data, start[rows], end[rows]))
        if len(new):
            new = rows[new]
            self._learn(np.arange(before, len(self.store)), [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())])
        ids, reach = self.store.lay_out(number, {i: self._whole(raw[start[i] : end[i]].decode()) for i in np.flatnonzero(long).tolist()})
        cuts = [0, *(4 * reach[stops]).tolist()]
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


_OWN: dict[str, Encoder] = {}


def encoder(path: str = BYTE_BPE) -> Encoder:
    """This worker's encoder."""
    if path not in _OWN:
        _OWN[path] = Encoder(path)
    return _OWN[path]
