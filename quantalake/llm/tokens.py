"""Token ids of whole texts by a public tokenizer: each distinct word of a block of texts is encoded once.

Arrow splits a block's texts into parts and numbers the distinct ones; the library encodes those; NumPy puts the ids of
all texts together. A block has a bounded number of bytes, so the memory that this takes is bounded too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a block, words that are encoded as one text, and words whose ids are put together at a time.
BLOCK_BYTES, JOINED, WORDS = 8 << 20, 400, 1 << 17
#: White space before a space or a newline, or after a newline: only there could cutting change the pieces of byte-level
#: vocabularies.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_WHITE}[ \n]|\n{_WHITE}"
#: Letters whose lower case depends on others, or that rules for text may change.
_CARE = r"[\x{130}\x{3a3}\x{2000}-\x{10ffff}]"
#: ASCII characters that are neither letters nor digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level vocabularies write these bytes as themselves and the others as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)} | {32: 32}


def blocks(batch: pa.RecordBatch, text: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``most`` bytes at most; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(before, before[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Table:
    """The ids of numbered things, end to end."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths.astype(np.int32)
        self.starts = np.cumsum(lengths, dtype=np.int64) - lengths

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of things by their numbers, end to end."""
        out, at = np.empty(int(self.lengths[numbers].sum()), self.flat.dtype), 0
        for a in range(0, len(numbers), WORDS):
            own = numbers[a : a + WORDS]
            n = self.lengths[own]
            size = int(n.sum())
            np.take(self.flat, np.repeat(self.starts[own] - np.cumsum(n) + n, n) + np.arange(size), out=out[at : at + size], mode="clip")
            at += size
        return out


class Encoder:
    """Encodes texts to ids as ``encode(text, add_special_tokens=False)`` does.

    The strings of added tokens get their own ids, as the library has it; a text that holds one is encoded in one go.

    ``kind`` says where a text may be cut without changing its ids. ``spaced``: byte-level vocabularies whose pieces
    may start with one space and never hold a space after another character; cuts are before single spaces and at
    single newlines, and a text that has white space before a space or newline, or after a newline, is encoded in one go. ``words``:
    vocabularies that drop white space and mark the ends of words.

    Parts that are one run of letters, marks at its end apart, are encoded many at a time by the bare merges: the
    vocabulary tells where each begins or ends. All other parts go through the whole tokenizer one by one. ``code``:
    ``<u2`` or ``<u4``.
    """

    def __init__(self, path: str, kind: str, code: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.bare = Tokenizer(self.tokenizer.model)  # for runs of letters, which the rules for text leave whole
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.spaced, self.code = kind == "spaced", code
        #: What makes a text one that is encoded in one go; tokens that are sought in normalised text could be anywhere.
        whole = [_ODD] * self.spaced + [re.escape(t.content) for t in added]
        self.whole = "" if any(t.normalized for t in added) and self.tokenizer.normalizer else "|".join(whole) or None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin (spaced) or end a word
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.spaced else t.endswith("</w>"))]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of words that are one run of letters each (with a space before, for ``spaced``), and their numbers."""
        parts = [runs[a : a + JOINED] for a in range(0, len(runs), JOINED)]
        lead = "\u0120" if self.spaced else ""  # what stands for a space
        joined = [lead + (" " + lead).join(p) for p in map(_as_letters, parts)]
        flat, lengths = [], []
        for own, e in zip(parts, self.bare.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.code)
            at = np.flatnonzero(self.edge[ids])
            cuts = np.append(at, len(ids)) if self.spaced else np.append(0, at + 1)
            if len(cuts) == len(own) + 1 and not cuts[0] and cuts[-1] == len(ids):
                flat.append(ids)
                lengths.append(np.diff(cuts))
            else:
                each = self._ids([(" " if self.spaced else "") + w for w in own])
                flat.append(np.array([i for x in each for i in x], self.code))
                lengths.append(np.array([len(x) for x in each]))
        return flat, lengths

    def _parts(self, parts: pa.Array) -> Table:
        """The ids of distinct parts of texts: each is a newline or nothing, a body, and a run of marks or nothing."""
        body = pc.utf8_rtrim(parts, MARKS)
        simple = pc.utf8_is_alpha(body)
        if self.spaced:
            run = body
        else:
            simple = pc.and_(simple, pc.or_(pc.string_is_ascii(body), pc.and_(pc.invert(pc.match_substring_regex(body, _CARE)), pc.equal(pc.utf8_normalize(body, "NFC"), body))))
            run = pc.utf8_lower(body)
        simple = simple.to_numpy(zero_copy_only=False)
        runs = pc.dictionary_encode(run.filter(pa.array(simple)))
        flat, lengths = self._runs(runs.dictionary.to_pylist())
        three = np.zeros((len(parts), 3), np.int64)  # the numbers of its things; 0 is nothing, 1 a newline
        three[simple, 1] = runs.indices.to_numpy(zero_copy_only=False)
        size = (pc.binary_length(parts).to_numpy(zero_copy_only=False) - pc.binary_length(body).to_numpy(zero_copy_only=False)) * simple
        ends: dict[str, int] = {"": 0, "\n": 1}
        some = np.flatnonzero(size)
        for k, text, n in zip(some.tolist(), parts.take(pa.array(some)).to_pylist(), size[some].tolist(), strict=True):
            three[k, 2] = ends.setdefault(text[-n:], len(ends))
        other = np.flatnonzero(~simple)
        texts = parts.take(pa.array(other)).to_pylist()
        if self.spaced:  # after a newline there is no space
            after = pc.starts_with(parts, "\n").to_numpy(zero_copy_only=False)[other]
            three[other, 0] = after
            texts = [t[1:] if x else " " + t for t, x in zip(texts, after.tolist(), strict=True)]
        first = self._ids(list(ends))
        rest = self._ids(texts)
        three[simple, 1] += len(first)
        three[other, 1] = len(first) + len(runs.dictionary) + np.arange(len(other))
        flat = [*(np.array(x, self.code) for x in first), *flat, np.array([i for x in rest for i in x], self.code)]
        lengths = [np.array([len(x) for x in first]), *lengths, np.array([len(x) for x in rest], np.int64)]
        things = Table(np.concatenate(flat), np.concatenate(lengths))
        return Table(things.of(three.ravel()), things.lengths[three].sum(axis=1))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column; null is empty."""
        texts = pc.fill_null(column, "")
        odd = np.zeros(len(texts), bool)
        if self.spaced:
            texts = pc.binary_join_element_wise("\n", texts, "")  # the first part, too, comes after a newline
        skip = 1 if self.spaced else 0
        if self.whole is not None:
            odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
            whole = [t[skip:] for t in texts.filter(pa.array(odd)).to_pylist()]
            texts = pc.if_else(pa.array(odd), "\n" * skip, texts)
        if self.spaced:
            split = pc.split_pattern(pc.utf8_slice_codeunits(pc.replace_substring(texts, "\n", " \n"), 1), " ")
        else:
            split = pc.ascii_split_whitespace(texts)
        del texts
        cuts = split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()
        words = pc.dictionary_encode(split.flatten())
        del split
        table, numbers = self._parts(words.dictionary), words.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(table.lengths[numbers], dtype=np.int64)])[cuts]
        flat = table.of(numbers)
        out = [flat[a + skip : b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        if odd.any():
            for k, ids in zip(np.flatnonzero(odd).tolist(), self._ids(whole), strict=True):
                out[k] = np.array(ids, self.code)
        return out


def _as_letters(words: list[str]) -> list[str]:
    joined = " ".join(words)
    return joined.split(" ") if joined.isascii() else joined.encode().decode("latin-1").translate(_LETTERS).split(" ")


def kind_of(path: str) -> str:
    """How the tokenizer file treats white space: ``words`` if it ends words with a suffix, else ``spaced``."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return "words" if model.get("end_of_word_suffix") else "spaced"


def code_of(path: str) -> str:
    """The NumPy code of the narrowest unsigned integers that hold every id."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
