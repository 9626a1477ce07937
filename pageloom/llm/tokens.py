"""Encoding whole texts with a public tokenizer, with a memory of the pieces seen.

A space before a character that isn't white space always starts a new pre-token of a
byte-level tokenizer, and so does a line break between two such characters. A text thus
falls into pieces that encode on their own; each worker remembers the ids of short ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pageloom.llm.common import in_arrow, kept_in_worker, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A generation of remembered pieces; a worker keeps this one and the last. Longer pieces are not remembered.
REMEMBERED, LONGEST = 400_000, 64
_WHITE_RUN, _CUT = re.compile(r"\s\s"), re.compile(r" (?=\S)")
_TAIL = ".,;:!?"
#: A byte-level vocabulary shows a byte that isn't a visible Latin-1 character as one of the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class _Pieces(dict):
    """Ids of a piece with a space before it, or of a piece that starts with its line break."""

    def __init__(self, whole, merge):
        self.whole, self.merge, self.older, self.marks = whole, merge, {}, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            word = piece.rstrip(_TAIL)
            tail, broken = piece[len(word):], word[:1] == "\n"
            letters = word[broken:]
            # Letters, the marks after them and a line break before them are pre-tokens of their own.
            if letters.isalpha() and len(tail) < 3:
                if broken:
                    ids = self.mark("\n") + self.merge(letters)
                else:  # the bare word may be known
                    ids = self[word] if tail else self.merge(" " + letters)
                ids += self.mark(tail)
            else:
                ids = self.whole(piece if broken else " " + piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def mark(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self.whole(text) if text else b""
        return self.marks[text]


class Encoder:
    """Ids of texts as little-endian unsigned integers, of 16 bits if the vocabulary allows, else of 32."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.known = _Pieces(self.whole, self._merge)

    def forget(self) -> None:
        """Drop the remembered pieces."""
        self.known.clear()
        self.known.older = {}

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, word: str) -> bytes:
        """Ids of one pre-token."""
        if word.isascii():  # letters, after a space at most
            shown = word.replace(" ", chr(_SHOWN[32]))
        else:
            shown = word.encode().decode("latin-1").translate(_SHOWN)
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if _WHITE_RUN.search(text) or text[-1:].isspace():  # only spaces before other characters cut here
                pieces = _CUT.split(text)
            else:
                pieces = text.replace("\n", " \n").split(" ")
            first, rest = pieces[0], pieces[1:]
            ids = itemgetter(*rest)(self.known) if len(rest) > 1 else map(self.known.__getitem__, rest)  # one key gives no tuple
            out.append(b"".join([self.whole(first) if first else b"", *ids]))
        return out


def shipped(docs: DataFrame, vocabulary: str):
    """The vocabulary file's text, broadcast once: executors need no copy of the file."""
    with open(vocabulary, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoder(spec) -> Encoder:
    return kept_in_worker(f"encoder_{hash(spec.value)}", lambda: Encoder(spec.value))


def token_counts(docs: DataFrame, name: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``docs`` but for ``text``, with its number of ids (null: 0) as ``name``."""
    spec = shipped(docs, vocabulary)
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc = encoder(spec)
        for batch in slices(batches, text, 4 << 20):
            n = [len(x) // enc.dtype.itemsize for x in enc.encode(batch.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int64())], names=schema.names)

    return docs.transform(in_arrow, run, schema)
