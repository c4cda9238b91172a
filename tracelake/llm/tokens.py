"""Token ids of whole texts by a public tokenizer file.

Byte-level tokenizers cut a text before each run of white space ahead of anything
else, so a text may be encoded word by word, and words repeat. Each task remembers
the ids of the words it has met; new words of a batch go to the library together.
Files of other kinds are handed whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

ID = np.dtype("<u4")
PAIR = re.compile(r"\s\s")
BEFORE_RUN = re.compile(r"(?<=\S)(?= )")
BATCH = 128
MARKS = ".,;:!?#*%$&|"
# White space besides the space and the line end, and the mark that this memory uses itself.
ODD = [*(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in " \n"), "\0"]


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Ids of words after a space; those not met yet come from the encoder."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder._word(word, " ")
        if len(word) <= self.encoder.longest and "\n" not in word:
            self[word] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. remembered: words kept at most; then the memory starts anew."""

    def __init__(self, path: str, remembered: int = 500_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cutter = kind.get("pre_tokenizer") or {}
        self.by_word = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not kind.get("normalizer")
        self.remembered, self.longest = remembered, longest
        self.words = Words(self)
        self.byte_text = byte_characters()
        self.line = self._whole("\n") if self.by_word else b""

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _letters(self, word: str) -> bytes:
        """A run of letters, after a space or not, is one piece: it goes to the library's model as it is."""
        written = word.encode().decode("latin-1").translate(self.byte_text)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, word: str, space: str) -> bytes:
        """Ids of a word after space, cut where its letters end and at a line end."""
        if word.isalpha():
            return self._letters(space + word)
        if "\n" in word[1:-1] and word[0] != "\n" and not PAIR.search(word):
            first, *rest = word.split("\n")
            if not rest[-1]:  # a line end that ends the word stays with its last line
                rest[-2:] = [rest[-2] + "\n"]
            return self.line.join([self._word(first, space), *(self._word(part, "") for part in rest)])
        body = word.rstrip(MARKS)
        if body.isalpha():
            return (self.words[body] if space else self._letters(body)) + self._marks(word[len(body) :])
        return self._whole(space + word)

    def _marks(self, marks: str) -> bytes:
        known = self.words.get(f"\0{marks}")
        if known is None:
            known = self.words[f"\0{marks}"] = self._whole(marks)
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, ID).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if "  " in text or " \n" in text or text.endswith(" ") or any(c in text for c in ODD):
                # Only the first space of a run of white space is a safe place to cut.
                first, *rest = BEFORE_RUN.split(text)
                out.append(b"".join([self._whole(first), *map(self._whole, rest)]))
                continue
            first, *rest = text.split(" ")
            if len(self.words) > self.remembered:
                self.words.clear()
            out.append(self._word(first, "") + b"".join(map(self.words.__getitem__, rest)))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoded(batches: Iterator, tokenizer: str, end_id: int) -> Iterator:
    """Batches (doc_id, text) -> batches (doc_id, ids), in the worker.

    Operators put what follows into the same function: a further step of its own
    would get workers of its own, each with another memory of words.
    """
    import pyarrow as pa

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    known, end = encoder(tokenizer), np.array([end_id], ID).tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ids = known.encode([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "ids"])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids of the whole text and end_id, as little-endian unsigned 32-bit bytes.

    A null text counts as empty, so each row has end_id at least. Rows stay in their
    partitions and order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encoded(batches, tokenizer, end_id), f"doc_id {kind}, ids binary")
