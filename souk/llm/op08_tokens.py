"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that give one token are the proven set. A text is cut at white
space, which the tokenizer drops; a chunk is cut into pre-tokens; a pre-token in the proven set counts as one token at
once and only the others go through the merges. Counts of chunks seen before are kept in a bounded table.

The shortcut takes chunks of printable ASCII, where lower-casing and the pre-token pattern are certain; any other chunk,
and any that may hold a special string, goes to the library whole. Chunks never interact: normalisation doesn't
compose across white space and no pre-token spans it.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows that repeat are counted each; an empty table gives
no rows; texts are never cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from souk.llm.common import binary_column, slices, with_text

#: Contractions, letters, single digits, other characters: the tokenizer's pre-token pattern on lower-case ASCII.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Chunks whose counts a worker keeps; beyond that it starts again.
KEPT_CHUNKS = 400_000
LIMIT = 2048


def prove_whole(model: str) -> list[str]:
    """The vocabulary strings that the library encodes alone as exactly one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    suffix = json.loads(model)["model"].get("end_of_word_suffix") or ""
    candidates = sorted({v.removesuffix(suffix) for v in tokenizer.get_vocab(with_added_tokens=False) if v.endswith(suffix) and v.isascii() and v.isprintable()} - {""})
    candidates = [c for c in candidates if PRE_TOKEN.fullmatch(c)]
    return [c for c, e in zip(candidates, tokenizer.encode_batch(candidates, add_special_tokens=False), strict=True) if len(e.ids) == 1]


class TokenCounts(dict):
    """Chunk of bytes without white space -> number of tokens."""

    def __init__(self, model: str, whole: list[str], kept: int = KEPT_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.whole, self.kept = Tokenizer.from_str(model), frozenset(whole), kept

    def __missing__(self, chunk: bytes) -> int:
        n = self.count(chunk)
        if len(self) >= self.kept:
            self.clear()
        self[chunk] = n
        return n

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, chunk: bytes) -> int:
        text = chunk.decode()
        if not text.isascii() or not text.isprintable() or "<|" in text:
            return self.merged(text)
        return sum(1 if p in self.whole else self.merged(p) for p in PRE_TOKEN.findall(text.lower()))

    def text(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row. vocabulary: path of the tokenizer's JSON, read on the driver.

    What is sent to the workers, the JSON and the proven set, is bounded by the vocabulary.
    """
    with open(vocabulary, encoding="utf-8") as file:
        model = file.read()
    whole = prove_whole(model)
    shared = docs.sparkSession.sparkContext.broadcast((model, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in slices(batches, "_text"):
            counts = counts if counts is not None else TokenCounts(*shared.value)
            texts = binary_column(batch, "_text")
            tokens = [counts.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = with_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
