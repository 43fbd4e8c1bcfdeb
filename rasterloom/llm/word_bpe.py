"""Whole columns of texts to ids, for tokenizers that lower-case, drop white space and merge inside words only.

The words of a block are put into one dictionary, and each different word is tokenized once. Words of ASCII and Latin-1 letters
with a tail of ASCII punctuation are tokenized all at once: one array holds the symbols of all words, and each round merges the
pair of lowest rank of every word. All other words go through the library, and so does everything where the tokenizer's file
is of another kind.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(0x7FFFFFFF)  # the rank of a pair that is never merged
KNOWN = 200_000  # words kept from block to block
SLOTS = 1 << 20  # of the table of pairs
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

# The parts of the tokenizer's file that this module knows the meaning of.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SUFFIX = "</w>"
SAMPLE = ["", "The", "letters,", "aaaaaaa", "Élève...", "straße!?", "mississippi", "unbelievably", "ÀÞ", "x", "###"]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    letter, mark = np.zeros(256, bool), np.zeros(256, bool)
    for b in range(128):
        letter[b] = chr(b).isalpha()
        mark[b] = 32 < b < 127 and not chr(b).isalnum()
    return letter, mark


_LETTER, _MARK = _classes()


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of ranges, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class WordBPE:
    """A tokenizer with the words it met last."""

    def __init__(self, data: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.words = pa.array([], pa.large_binary())
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.fast = self._read(json.loads(data)) and self._agrees()

    def _read(self, file: dict) -> bool:
        """The tables of a file of the known kind; False for any other."""
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        pre = pre.get("pretokenizers") or [{}]
        known = (file.get("normalizer") or {}).get("normalizers") == NORMALIZERS and len(pre) == 2
        known = known and pre[0].get("type") == "Split" and pre[0]["pattern"] == {"Regex": SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        known = known and pre[1].get("type") == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and model["type"] == "BPE" and model["end_of_word_suffix"] == SUFFIX
        if not known or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")) or len(model["vocab"]) >= 1 << 20:
            return False
        vocab, letters = model["vocab"], _byte_letters()
        if any(c not in vocab or c + SUFFIX not in vocab for c in letters):
            return False
        self.inner, self.last = (np.array([vocab[c + end] for c in letters], np.int32) for end in ("", SUFFIX))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):  # what is merged must be made earlier, else rounds do not equal single steps
            if made.get(a, -1) > rank or made.get(b, -1) > rank:
                return False
            made.setdefault(a + b, rank)
        if any(made.get(x, -1) >= rank for rank, p in enumerate(pairs) for x in p):
            return False
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.key, self.rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[slot[todo]] < 0
            at, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.key[at], self.rank[at] = keys[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) % SLOTS
        return len(np.unique(keys)) == len(keys)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(44)).astype(np.int64)

    def _agrees(self) -> bool:
        words = [w.encode() for w in SAMPLE]
        one, two = self._together(pa.array(words, pa.large_binary())), self._one_by_one(words)
        return np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        found, out = self.key[slot], self.rank[slot]
        wrong = np.flatnonzero((found != key) & (found >= 0))
        out[found != key] = NONE
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % SLOTS
            found = self.key[slot[wrong]]
            hit = found == key[wrong]
            out[wrong[hit]] = self.rank[slot[wrong[hit]]]
            wrong = wrong[~hit & (found >= 0)]
        return out

    def _merge(self, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Merge inside the words that begin where ``first``; ``symbol`` is changed in place, the mask says what remains."""
        held, place, alive = symbol.copy(), np.arange(len(symbol)), np.ones(len(symbol), bool)
        rank = np.full(len(symbol), NONE, np.int32)
        inside = np.flatnonzero(~first[1:])
        rank[inside] = self._ranks(held[inside], held[inside + 1])
        while len(held):
            begin = np.flatnonzero(first)
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(held))))
            at = np.flatnonzero((rank == least) & (least != NONE))
            if len(at) and (np.diff(at) == 1).any():  # a pair of two equal symbols in a longer run: from the left
                run = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at) > 1)), at, 0))
                at = at[(at - run) % 2 == 0]
            held[at] = self.product[rank[at]]
            symbol[place[at]] = held[at]
            alive[place[at + 1]] = False
            keep, fresh = least != NONE, np.zeros(len(held), bool)
            keep[at + 1], fresh[at] = False, True
            held, place, first, rank, fresh = held[keep], place[keep], first[keep], rank[keep], fresh[keep]
            if not len(held):
                break
            fresh[:-1] |= fresh[1:]
            rank[fresh] = NONE
            fresh[:-1] &= ~first[1:]
            fresh[-1] = False
            at = np.flatnonzero(fresh)
            rank[at] = self._ranks(held[at], held[at + 1])
        return alive

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for own in found for i in own), np.uint32, size.sum()), size

    def _together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has) of plain words; a word of no bytes has none."""
        offset = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
        begin, size = offset[:-1] - offset[0], np.diff(offset)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        first = np.zeros(len(data), bool)
        first[begin[size > 0]] = True
        mark = _MARK[data]
        first[1:] |= mark[1:] & ~mark[:-1]
        capital = (data >= 65) & (data <= 90)
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
        low = data + (capital * np.uint8(32))
        ends = np.append(first[1:], True)
        symbol = np.where(ends, self.last[low], self.inner[low])
        alive = self._merge(symbol, first)
        many = np.concatenate(([0], np.cumsum(alive)))
        return symbol[alive].astype(np.uint32), many[begin + size] - many[begin]

    @staticmethod
    def _plain(words: pa.Array) -> np.ndarray:
        """Which words are letters of ASCII or Latin-1 and then ASCII punctuation, either perhaps none."""
        offset = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
        if not len(data):
            return np.ones(len(words), bool)
        lead = data == 0xC3
        letter, mark = _LETTER[data] | lead, _MARK[data]
        letter[1:] |= lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the signs of multiplication and division
        first = np.zeros(len(data) + 1, bool)
        first[offset[:-1] - offset[0]] = True
        bad = ~(letter | mark)
        bad[1:] |= letter[1:] & mark[:-1] & ~first[1:-1]
        many = np.concatenate(([0], np.cumsum(bad)))
        at = offset - offset[0]
        return many[at[1:]] == many[at[:-1]]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        plain = self._plain(words) if self.fast else np.zeros(len(words), bool)
        size, parts = np.zeros(len(words), np.int64), []
        for mask, how in ((plain, self._together), (~plain, lambda w: self._one_by_one(w.to_pylist()))):
            ids, size[mask] = how(words.filter(pa.array(mask))) if mask.any() else (np.zeros(0, np.uint32), 0)
            parts.append(ids)
        start = np.zeros(len(words), np.int64)
        start[plain] = np.cumsum(size[plain]) - size[plain]
        start[~plain] = len(parts[0]) + np.cumsum(size[~plain]) - size[~plain]
        return np.concatenate(parts)[gather(start, size)], size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has): each text ends with ``end_id``; a null text is empty."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy()
        place = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(place))
        ids, size = self.encode_words(fresh)
        if len(self.words) + len(fresh) <= KNOWN:
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids, self.start = np.concatenate((self.ids, ids)), np.append(self.start, self.start[-1] + np.cumsum(size))
            start, count, flat = self.start[:-1], np.diff(self.start), self.ids
            at = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False)
        else:
            start, flat = np.concatenate((self.start[:-1], len(self.ids) + np.cumsum(size) - size)), np.concatenate((self.ids, ids))
            count = np.concatenate((np.diff(self.start), size))
            unknown = pc.is_null(place).to_numpy(zero_copy_only=False)
            at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[unknown] = len(self.words) + np.arange(unknown.sum())
        # words in the order of the texts, and one more for the end of each
        where = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        start, count = np.append(start, len(flat)), np.append(count, 1)
        order = np.insert(at[code], where[1:], len(start) - 1)
        out = np.append(flat, np.uint32(end_id))[gather(start[order], count[order])]
        many = np.concatenate(([0], np.cumsum(count[order])))
        return out, np.diff(many[where + np.arange(len(where))])
