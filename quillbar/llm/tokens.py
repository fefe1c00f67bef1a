"""Token ids of whole batches with a public tokenizer.

The tokenizer must drop white space and never look across it (as those do that split words before their merges). Then a
text's ids are the ids of its words one after the other, each distinct word is encoded once, and a text is
put together by gathering. The cache of words is kept by the Python worker and emptied at ``CACHE_WORDS``: arrays of hashes, of ids and of their
bounds, with no Python object for a word. New words are encoded as lines of ``LINE_WORDS``, and their ids told apart by where they begin.
"""

from __future__ import annotations

import os

import numpy as np

from quillbar.llm.words import U64, Texts

CACHE_WORDS = 1 << 20
LINE_WORDS = 64
LEAST_SLOTS = 1 << 16


class Numbers:
    """Distinct 64-bit hashes, numbered from 0 as they are added: a table of at least twice as many slots, each hash in the first free one from its own on."""

    def __init__(self):
        self.count = 0
        self._empty(LEAST_SLOTS)

    def _empty(self, slots: int) -> None:
        self.keys = np.zeros(slots, dtype=U64)
        self.number = np.full(slots, -1, dtype=np.int32)

    def _own(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & U64(len(self.keys) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not there."""
        at = self._own(hashes)
        out = self.number[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            here = at[wrong]
            out[wrong] = self.number[here]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[here] != hashes[wrong])]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number distinct hashes that are not there yet."""
        numbers = np.arange(self.count, self.count + len(hashes), dtype=np.int32)
        self.count += len(hashes)
        if 2 * self.count > len(self.keys):
            held = self.number >= 0
            hashes, numbers = np.append(self.keys[held], hashes), np.append(self.number[held], numbers)
            self._empty(1 << (2 * self.count - 1).bit_length())
        at = self._own(hashes)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.number[at[left]] < 0]
            # of several that want one slot the last written has it, the others go on
            self.number[at[free]] = numbers[free]
            won = self.number[at[left]] == numbers[left]
            self.keys[at[left[won]]] = hashes[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


def longer(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` after its first ``used`` values, with room to grow."""
    if used + len(more) > len(values):
        values = np.append(values[:used], np.zeros(max(used // 2, len(more)), dtype=values.dtype))
    values[used:used + len(more)] = more
    return values


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    _of: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """The worker's encoder for a vocabulary file, given by path or by the name of a public one."""
        if path not in cls._of:
            cls._of[path] = cls(path if os.path.sep in path else vocabulary(path))
        return cls._of[path]

    def forget(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(0, dtype=np.uint32)
        self.first = np.zeros(1, dtype=np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        lines = [words[i:i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        found = self.tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False)
        ids, counts = [], []
        for line, encoded in zip(lines, found):
            # a line's words end at a space each; ids begin in the word that they are of
            stop = np.cumsum([len(word) + 1 for word in line])
            begin = np.array([begin for begin, _ in encoded.offsets], dtype=np.int64)
            ids += encoded.ids
            counts.append(np.bincount(np.searchsorted(stop, begin, side="right"), minlength=len(line)))
        start = self.known.count
        used = int(self.first[start])
        self.ids = longer(self.ids, used, np.array(ids, dtype=np.uint32))
        self.first = longer(self.first, start + 1, used + np.cumsum(np.concatenate(counts)))
        self.known.add(hashes)

    def encode(self, texts: Texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, and the bounds of each text in them."""
        n = len(texts.offsets) - 1
        hashes = texts.hashes()
        where = self.known.find(hashes)
        new = np.flatnonzero(where < 0)
        if len(new):
            distinct, sample, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.known.count and self.known.count + len(distinct) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(hashes))
                distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            sample = new[sample]
            data = texts.data.tobytes()
            words = [data[a:b].decode("utf-8", "replace") for a, b in zip(texts.start[sample].tolist(), texts.end[sample].tolist())]
            where[new] = self.known.count + inverse
            self._learn(distinct, words)
        # one pseudo-word after each text stands for its end
        ends = texts.first[1:] + np.arange(n)
        is_end = np.zeros(len(where) + n, dtype=bool)
        is_end[ends] = True
        begin = np.zeros(len(is_end), dtype=np.int64)
        count = np.ones(len(is_end), dtype=np.int64)
        begin[~is_end], count[~is_end] = self.first[where], self.first[where + 1] - self.first[where]
        stop = np.cumsum(count)
        ids = self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - count), count)] if len(self.ids) else np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.uint32)
        ids[stop[ends] - 1] = end
        return ids, np.append(0, stop[ends])
