"""Token ids of whole texts, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from twinlake.llm.common import chunks, is_odd

#: Words that are encoded as one text, and the longest one that is.
TOGETHER, SHORT = 256, 100
#: Such texts, or single words, that are encoded by one call, and texts whose ids are taken at once.
GROUPS, ASSEMBLED = 32, 256
#: How a byte-level vocabulary writes a blank.
BLANK = "\u0120"
#: Marks that end words, and words on which the model alone must agree with the whole call, or it is not asked alone.
MARKS = ".,;:!?"
PROBES = ["a", "The", "word", "Unbelievably", "ndssttqxz", "UPPER", "t"]
#: Words after which a worker begins a new memory, beside which it keeps the last one, and the longest word it remembers.
REMEMBERED, LONGEST = 150_000, 40
#: Texts that are encoded together: their new words are found and encoded at once.
ENCODED = 2048


def spaced(text: str) -> list[str]:
    """Parts for a byte-level tokeniser, as keys: a bare word has a blank before it, a line's first word has a
    line feed before it, and a text's first word, or a part of a text with other white space, two."""
    if is_odd(text):
        return ["\n\n" + x for x in chunks(text)]
    out = []
    for line in text.split("\n"):
        words = line.split(" ")
        words[0] = "\n" + words[0]
        out += words
    out[0] = "\n" + out[0]
    return out


def spaced_text(key: str) -> str:
    if key[:1] != "\n":
        return " " + key
    return key[2:] if key[1:2] == "\n" else key


def words_only(text: str) -> list[str]:
    """Parts for a tokeniser that drops white space."""
    return [x for x in text.replace("\n", " ").split(" ") if x]


def word_text(key: str) -> str:
    return key


def spaced_marked(text: str) -> str | None:
    """The keys of ``spaced`` with a blank between them, or None for a text with other white space."""
    return None if is_odd(text) else "\n\n" + text.replace("\n", " \n")


def words_marked(text: str) -> str:
    """The parts of ``words_only``, and empty ones, with a blank between them."""
    return text.replace("\n", " ")


class Encoder:
    """A tokenizers file applied to whole texts; a word met again is not encoded again.

    The ids are those of the plain library call on the whole text with ``add_special_tokens=False``: a special
    token's string in a text gives that token."""

    _held: dict = {}

    def __init__(self, path: str, cut=spaced):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cut, self.memo = cut, {}
        self.said, self.marked = (spaced_text, spaced_marked) if cut is spaced else (word_text, words_marked)
        self.last: dict = {}
        #: By id, whether a token begins with the blank that stands before a word; None where the tokeniser drops white space.
        self.begins = None
        if cut is spaced:
            known = self.tok.get_vocab(with_added_tokens=True)
            self.begins = np.zeros(max(known.values()) + 1, bool)
            self.begins[[i for t, i in known.items() if t[:1] == BLANK]] = True

        #: What stands before a word of ASCII letters in the model's alphabet, and the ids of a mark that ends one: if such
        #: words are one piece for the model, and such marks another.
        self.lead = BLANK if cut is spaced else ""
        self.ends = {c: array("I", [t.id for t in self.tok.model.tokenize(c)]).tobytes() for c in MARKS}
        added = [str(t) for t in self.tok.get_added_tokens_decoder().values()]
        plain = lambda x: array("I", self.tok.encode(self.said(x), add_special_tokens=False).ids).tobytes()
        self.direct = not any(t.isalpha() or t[-1:] in MARKS for t in added) and all(self._letters(x) + end == plain(x + c) for x in PROBES for c, end in [("", b""), *self.ends.items()])

    def _letters(self, word: str) -> bytes:
        """The ids of a word of ASCII letters by the model alone; a tokeniser that drops white space is one that lowers case."""
        return array("I", [t.id for t in self.tok.model.tokenize(self.lead + word if self.lead else word.lower())]).tobytes()

    @classmethod
    def of(cls, path: str, cut=spaced) -> Encoder:
        """One per worker and file: workers are used again for later tasks."""
        key = (path, cut.__name__)
        if key not in cls._held:
            cls._held[key] = cls(path, cut)
        return cls._held[key]

    def _together(self, words: list[str]) -> None:
        """Remember words by encoding many as one text, a blank before each, which no token crosses; that blank or offsets part them."""
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        encode = self.tok.encode_batch if self.begins is None else self.tok.encode_batch_fast
        for at in range(0, len(groups), GROUPS):
            some = groups[at : at + GROUPS]
            for g, e in zip(some, encode([" " + " ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                if self.begins is None:
                    size = np.fromiter(map(len, g), "i8", len(g)) + 1
                    first = np.fromiter(chain.from_iterable(e.offsets), "i8", 2 * len(ids))[::2]
                    start = np.searchsorted(first, np.cumsum(size) - size)
                else:
                    start = np.flatnonzero(self.begins[ids])
                    if len(start) != len(g):  # left to be encoded one by one
                        continue
                cut, raw = [*(4 * start).tolist(), 4 * len(ids)], ids.tobytes()
                self.memo.update(zip(g, [raw[a:z] for a, z in zip(cut, cut[1:], strict=False)], strict=True))

    def _remember(self, words: list[str]) -> list[str]:
        """Encode those of the distinct ``words`` that are not remembered, and say which they are."""
        if len(self.memo) > REMEMBERED:  # words that come again are carried over, those that came once go
            self.last, self.memo = self.memo, {}
        memo, last = self.memo, self.last
        new = [x for x in words if x not in memo]
        if last:
            again = [x for x in new if x in last]
            memo.update(zip(again, map(last.__getitem__, again), strict=True))
            new = [x for x in new if x not in memo]
        if self.direct:
            letters, ends = self._letters, self.ends
            for x in new:
                if x.isascii():
                    if x.isalpha():
                        memo[x] = letters(x)
                    elif x[-1:] in ends and x[:-1].isalpha():
                        memo[x] = (memo.get(x[:-1]) or letters(x[:-1])) + ends[x[-1:]]
        self._together([x for x in new if x not in memo and x[:1] != "\n" and 0 < len(x) <= SHORT and "<|" not in x])
        rest = [x for x in new if x not in memo]
        for at in range(0, len(rest), GROUPS):
            some = rest[at : at + GROUPS]
            for x, e in zip(some, self.tok.encode_batch_fast(list(map(self.said, some)), add_special_tokens=False), strict=True):
                memo[x] = array("I", e.ids).tobytes()
        return new

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text: distinct words are looked up, and all words' ids are then taken at once."""
        texts = [t or "" for t in texts]
        marked = [self.marked(t) if t else None for t in texts]
        whole = [k for k, m in enumerate(marked) if m is not None]
        apart = {k: self.cut(t) for k, t in enumerate(texts) if t and marked[k] is None}
        split = pc.split_pattern(pa.array([marked[k] for k in whole], pa.large_string()), " ")
        del marked
        coded = split.flatten().dictionary_encode()
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(coded.dictionary) else []
        new = self._remember(list(set(words).union(*apart.values())) if apart else words)
        memo = self.memo
        get = memo.__getitem__
        out = [b""] * len(texts)
        for k, parts in apart.items():
            out[k] = b"".join(map(get, parts))
        held = list(map(get, words))
        size = np.fromiter(map(len, held), "i8", len(held)) // 4
        ids, first = np.frombuffer(b"".join(held), "<u4"), np.cumsum(size) - size
        at, ends = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False).astype("i8"))])
        for a in range(0, len(whole), ASSEMBLED):
            some = whole[a : a + ASSEMBLED]
            bound = ends[a : a + len(some) + 1]
            use = at[bound[0] : bound[-1]]
            n = size[use]
            end = np.concatenate([[0], np.cumsum(n)])
            taken = ids[np.repeat(first[use] - end[:-1], n) + np.arange(end[-1])].tobytes()
            cut = (4 * end[bound - bound[0]]).tolist()
            for k, x, y in zip(some, cut, cut[1:], strict=False):
                out[k] = taken[x:y]
        for x in new:
            if len(x) > LONGEST:
                del memo[x]
        return out


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
