"""Byte-level BPE of whole texts through the tokenizers library, with the ids of words remembered.

A byte-level pre-tokenizer starts a new word at a single blank between two non-blank characters, so a
text may be cut in front of it and the ids of the parts put one behind the other. Parts come back
often: of many texts each different part is looked up once, in Arrow arrays. A single line feed between two such
characters is a word of its own, so parts are cut in front of it too. Those not yet known are encoded together in one
call, and their ids told apart by byte lengths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from patcheval.llm.common import LONGEST, kept_by_worker, pieces

#: Punctuation that no special token has.
_TAIL = ".,%$&*#!?;:"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line feeds.
_WHITE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that may not be cut at every blank: blanks beside white space or at an end, and white space other than blanks and line feeds.
_UNEVEN = rf"  | \n|\n |\A | \z|[{_WHITE}]"
#: Words that are cut at their line feeds: single ones, neither at an end nor beside other white space.
_LINES = rf"\A[^ \n{_WHITE}]+(?:\n[^ \n{_WHITE}]+)+\z"
#: Words with a letter below U+02B0 before the marks of ``_TAIL`` at their end.
_MARKED = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}][.,%$&*#!?;:]{1,64}\z"
_NOTHING = pa.scalar(b"", pa.large_binary())
#: Bytes of texts whose parts are looked up together.
TOGETHER = 8_000_000


def _strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar object for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lists of the texts' parts, cut at their single blanks, which go, and the number of the text that each list is of."""
    uneven = np.asarray(pc.match_substring_regex(texts, _UNEVEN))
    if not uneven.any():
        return pc.split_pattern(texts, " "), np.arange(len(texts))
    cut = pa.array([_CUT.split(t) for t in _strings(texts.filter(pa.array(uneven)))], pa.large_list(pa.large_string()))
    even = pc.split_pattern(texts.filter(pa.array(~uneven)), " ").cast(cut.type)
    return pa.concat_arrays([even, cut]), np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)])


def _from_bytes(data, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values that lie one behind the other in ``data``, up to each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings or binaries, and the ends of its values in them, both from its first value on."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def _joined(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring values put together, up to each of ``ends``; none of the runs is empty."""
    data, to = _bytes_of(values)
    return _from_bytes(data, to[ends - 1], pa.large_binary())


def _ordered(values: pa.Array, order: np.ndarray) -> pa.Array:
    """The values, each at its number in ``order``."""
    return values if (np.diff(order) > 0).all() else values.take(pa.array(np.argsort(order)))


class Words:
    """Ids of words, computed once while a word is in use: a table of the words met since it was last thinned out, and of those kept
    then. With more than ``entries`` words met it keeps these and drops the others. Words are of up to ``LONGEST`` characters.
    ``learn`` gives the ids of a list of new words."""

    def __init__(self, learn, entries: int):
        self.learn, self.entries = learn, entries
        self.known, self.ids, self.met = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    def values(self, words: list[str]) -> pa.Array:
        """Ids of new words."""
        return self.learn(words)

    def take(self, words: pa.Array) -> pa.Array:
        """Ids of words, each new one asked for once."""
        found = pc.index_in(words, value_set=self.known)
        at, lacks = found.fill_null(-1).to_numpy().astype(np.int64), found.is_null()
        self.met[at[at >= 0]] = True
        fresh = words.filter(lacks).dictionary_encode()
        new, ids = fresh.dictionary, self.ids
        if len(new):
            at[at < 0] = len(ids) + fresh.indices.to_numpy()
            ids = pa.concat_arrays([ids, self.values(_strings(new))])
            kept = np.concatenate([np.ones(len(self.known), bool), pc.utf8_length(new).to_numpy() <= LONGEST])
            self._keep(pa.concat_arrays([self.known, new]), ids, np.concatenate([self.met, np.ones(len(new), bool)]), kept)
        if self.met.sum() > self.entries:
            self._keep(self.known, self.ids, np.zeros(len(self.met), bool), self.met)
        return ids.take(pa.array(at))

    def _keep(self, known: pa.Array, ids: pa.Array, met: np.ndarray, kept: np.ndarray) -> None:
        if not kept.all():
            known, ids, met = known.filter(pa.array(kept)), ids.filter(pa.array(kept)), met[kept]
        self.known, self.ids, self.met = known, ids, met


class WordEncoder:
    """``arrays`` gives for each text its ids as bytes: little-endian, of the type ``dtype``."""

    def __init__(self, path: str, entries: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.lengths = np.zeros(self.size, np.int64)
        for piece, i in vocabulary.items():
            self.lengths[i] = len(piece)  # a character of a byte-level piece stands for one byte
        self.words = Words(self._encode, entries)

    def _values(self, words: pa.Array) -> pa.Array:
        """Ids of different parts that follow a single blank. Lines of a part are looked up one by one, each with its line feed."""
        cut = np.asarray(pc.match_substring_regex(words, _LINES))
        lines = pc.split_pattern(pc.replace_substring(words.filter(pa.array(cut)), "\n", " \n"), " ")
        whole = words.filter(pa.array(~cut))
        ids = self._lines(pa.concat_arrays([whole, lines.flatten()]))
        ends = np.cumsum(pc.list_value_length(lines).to_numpy())
        both = pa.concat_arrays([ids.slice(0, len(whole)), _joined(ids.slice(len(whole)), ends)])
        return _ordered(both, np.concatenate([np.flatnonzero(~cut), np.flatnonzero(cut)]))

    def _lines(self, words: pa.Array) -> pa.Array:
        """Ids of words that follow a blank or start with a line feed. Punctuation behind a letter is a word of its own to the
        pre-tokenizer: it is taken off first, as the rest is often known."""
        bare = pc.utf8_rtrim(words, _TAIL)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(bare)).to_numpy()
        at = np.flatnonzero(cut)
        at = at[np.asarray(pc.match_substring_regex(words.take(pa.array(at)), _MARKED))]
        marked = np.zeros(len(words), bool)
        marked[at] = True
        ids = self.words.take(pc.if_else(pa.array(marked), bare, words))
        if not len(at):
            return ids
        # one byte a mark
        data, ends = _bytes_of(words.take(pa.array(at)))
        sizes = cut[at].astype(np.int64)
        to = np.cumsum(sizes)
        tails = _from_bytes(data[np.arange(to[-1]) + np.repeat(ends - to, sizes)], to, pa.large_string()).dictionary_encode()
        coded = pa.concat_arrays([self._each(tails.dictionary), pa.array([b""], pa.large_binary())])
        number = np.full(len(words), len(coded) - 1)
        number[at] = tails.indices.to_numpy()
        return pc.binary_join_element_wise(ids, coded.take(pa.array(number)), _NOTHING)

    def _each(self, texts: pa.Array) -> pa.Array:
        """Ids of each text alone."""
        ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(_strings(texts), add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * self.dtype.itemsize
        return _from_bytes(np.concatenate(ids) if ids else b"", ends, pa.large_binary())

    def _encode(self, words: list[str], at_once: int = 4000) -> pa.Array:
        """Ids of words behind a blank, or with the line feed they start with, encoded as one text for each group of them and told
        apart by their bytes."""
        out = []
        for i in range(0, len(words), at_once):
            group = [w if w.startswith("\n") else f" {w}" for w in words[i : i + at_once]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.cumsum(pc.binary_length(pa.array(group, pa.large_string())).to_numpy())
            at = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1
            out.append(_from_bytes(ids, at * self.dtype.itemsize, pa.large_binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def _some(self, texts: pa.Array) -> pa.Array:
        """``texts`` that are whole, or go on at a cut and then start with its blank."""
        lists, order = _parts(texts)
        parts, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
        head = np.zeros(len(parts), bool)
        head[np.concatenate([[0], ends[:-1]])] = True
        coded = parts.filter(pa.array(~head)).dictionary_encode()
        values = self._values(coded.dictionary)
        number = np.empty(len(parts), np.int64)
        number[head], number[~head] = len(values) + np.arange(len(ends)), coded.indices.to_numpy()
        # the ids of each part are taken from those of the different ones
        ids = pa.concat_arrays([values, self._each(parts.filter(pa.array(head)))]).take(pa.array(number))
        return _ordered(_joined(ids, ends), order)

    def arrays(self, texts: list[str] | pa.Array) -> Iterator[pa.Array]:
        """The ids of neighbouring texts, an array for each group that is looked up together."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            if to == at + 1:
                some = [self._some(pa.array([x], pa.large_string())) for x in pieces(texts[at].as_py(), _CUT)]
                yield pa.array([b"".join(x[0].as_py() for x in some)], pa.large_binary())
            else:
                yield self._some(texts.slice(at, to - at))
            at = to

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """:meth:`arrays`, text by text."""
        for some in self.arrays(texts):
            yield from some.to_pylist()


def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return kept_by_worker(WordEncoder, path)
