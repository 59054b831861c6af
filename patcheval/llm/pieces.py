"""SentencePiece BPE, encoded by backtracking and decoded again.

The ids of a text are the one sequence of pieces in which each two neighbours, merged anew from their
characters, come out as these two pieces. It is found from the left: take the longest piece that starts
here (Aho-Corasick), check it against the piece before by re-merging both, and try the next shorter one
if they do not go together; with none left, mark the position as failed and step back one piece. A
position is reached by one valid sequence only, so one bit for each position is enough to never try one twice.

No piece of the vocabulary has a word mark behind another character, so nothing merges across the start of
a word: words are encoded one by one and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patcheval.llm.common import Recent, each_freed, groups, kept_by_worker, pieces, shared_out, text_of, tokenizer_file

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
# fixed values: kinds of pieces in a model file
_NORMAL, _CONTROL, _BYTE = 1, 3, 6


class PieceModel:
    """Pieces, scores and byte pieces of a BPE model with byte fallback and without normalisation rules.

    Other kinds of models (unigram, rules for characters, user-defined or unused pieces) raise ValueError.
    """

    def __init__(self, path: str, pairs: int = 500_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if spec.model_type != 2 or not spec.byte_fallback or kinds - {_NORMAL, 2, _CONTROL, _BYTE}:
            raise ValueError("only BPE models with byte fallback and normal pieces are read")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave characters and blanks as they are are read")
        if not rules.add_dummy_prefix:
            raise ValueError("only models that put a word mark in front of a text are read")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside")
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.raw = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.raw |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == (spec.eos_piece or "</s>"))
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.pairs = pairs

    def merge(self, text: str) -> list[str]:
        """BPE by merging the best pair, leftmost first, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _go_together(self, left: str, right: str) -> bool:
        if len(self.fits) > self.pairs:
            self.fits.clear()
        ok = self.fits[left, right] = self.merge(left + right) == [left, right]
        return ok

    def _shorter(self, piece: str) -> str | None:
        """The next shorter piece that a text starting with ``piece`` starts with; at last its first character."""
        for n in range(len(piece) - 1, 1, -1):
            if piece[:n] in self.ids:
                return piece[:n]
        return piece[0] if len(piece) > 1 else None

    def _longest(self, word: str, at: int) -> str:
        """The longest piece that starts at a position, or the character there."""
        if len(word) <= 256:
            for end, piece in self.matcher.iter_long(word, at):
                return piece if end + 1 - len(piece) == at else word[at]
        return word[at]

    def cut(self, word: str) -> list[str]:
        """Pieces of a word; a character that is no piece stands for itself."""
        n = len(word)
        longest: list[str | None] = [None] * n
        # of a short word only the matches that follow one another, more where they are asked for
        for end, piece in self.matcher.iter_long(word) if n <= 256 else self.matcher.iter(word):
            longest[end + 1 - len(piece)] = piece  # for each start the last one met is the longest
        out: list[str] = []
        failed = bytearray(n // 8 + 1)
        at, piece = 0, longest[0] or self._longest(word, 0)
        fits, shorter, alone = self.fits, self.shorter, self.alone
        while True:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    own = alone.get(piece)
                    if own is None:
                        own = alone[piece] = self.merge(piece) == [piece]
                    if own:
                        if not out:
                            break
                        ok = fits.get((out[-1], piece))
                        if ok or ok is None and self._go_together(out[-1], piece):
                            break
                if piece not in shorter:
                    shorter[piece] = self._shorter(piece)
                piece = shorter[piece]
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = self._shorter(last)
                continue
            out.append(piece)
            at = end
            if at == n:
                return out
            piece = longest[at] or self._longest(word, at)

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def decode_bytes(self, ids) -> bytes:
        """The bytes of the ids' pieces; control pieces have none."""
        return b"".join([self.raw.get(i, b"") for i in ids])

    def decode(self, ids) -> str:
        """The text of the ids, without the blank that encoding has put in front; bytes that are no UTF-8 become U+FFFD."""
        text = self.decode_bytes(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class PieceEncoder:
    """Encodes and decodes whole texts, remembering up to twice ``entries`` words."""

    def __init__(self, path: str, entries: int = 250_000):
        self.model = PieceModel(path)
        self.recent = Recent(self._learn, entries)

    def _words(self, text: str, first: bool) -> list[str]:
        """Words, each without the mark in front of it. ``first``: the text's start, where the model puts a mark."""
        if MARK not in text and "  " not in text and (text[:1] != " " if first else text[:1] == " "):
            return (text if first else text[1:]).split(" ")
        return [w[1:] for w in _WORDS.findall((MARK if first else "") + text.replace(" ", MARK))]

    def _learn(self, words: list[str]) -> list[tuple[str, str]]:
        """Ids of each word as text, and the text they decode to."""
        m, out = self.model, []
        for w in words:
            ids = m.ids_of(m.cut(MARK + w))
            out.append((" ".join(map(str, ids)), m.decode_bytes(ids).decode("utf-8", "replace")))
        return out

    def rows(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text) for each text."""
        end = str(self.model.end_id)
        for some in groups(texts):
            if len(some) == 1:
                yield self._long([self._words(t, i == 0) for i, t in enumerate(pieces(some[0], _CUT)) if t], end)
                continue
            lists = [self._words(t, True) if t else [] for t in some]
            for found in shared_out(lists, self.recent.values(list(chain.from_iterable(lists)))):
                x = " ".join([*[f[0] for f in found], end])
                y = "".join([f[1] for f in found])[1:]  # the blank of the first mark
                yield x.count(" ") + 1, hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(y.encode()).hexdigest()

    def _long(self, lists: list[list[str]], end: str) -> tuple[int, str, str]:
        """The same for the parts of one text."""
        n, a, b, skip = 1, hashlib.sha256(), hashlib.sha256(), 1
        for words in lists:
            found = self.recent.values(words)
            x = " ".join([*[f[0] for f in found], ""])
            a.update(x.encode())
            b.update("".join([f[1] for f in found])[skip:].encode())
            n, skip = n + x.count(" "), 0
        a.update(end.encode())
        return n, a.hexdigest(), b.hexdigest()


def piece_encoder(path: str) -> PieceEncoder:
    """One for all tasks of a worker."""
    return kept_by_worker(PieceEncoder, path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)

        def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(encoder.rows(batch.column("text").to_pylist()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        yield from each_freed(batches, encoded)

    return run


def encode_and_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: its text (null: empty) encoded with an end id
    only, and decoded from the ids. An empty text has the end id alone and decodes to ''. Rows repeat as they
    come, ids may be null; nothing is shuffled. A worker remembers a bounded number of words and pairs.
    """
    model = model or tokenizer_file("piece_bpe_32k.model")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(
        _run(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
