"""Byte-level BPE encoding and decoding, each distinct word of a corpus merged once.

Documents are cut into pre-tokens ("words") in slices of some megabytes of text. A slice sends each of its distinct words, numbered, once
to the task that owns the word; there equal words lie side by side, each is merged by the ranks once and its ids go back to every slice that
asked. A slice's rows keep which word stands at which position of which document, packed; the ids are put together in that order.
So a word that a third of all positions hold is one row a slice.

Decoding joins ids with the token-byte table. That table is as large as the vocabulary, so every task has it and no row is shuffled.

Documents must come in the same order when a task is repeated, as a scan or a written table gives them: the words of a slice and its
positions are taken in two passes. A slice whose answers are not as many as its words fails the job.

Defined results: a null or empty text has no ids, which decode to no bytes; special strings are ordinary text; rows that repeat are encoded
each; texts are never cut; a null list of ids decodes to null, and so does a list with a null or an id that the table doesn't have;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import pack_gaps, parts, text_bytes, unpack_gaps, with_text

#: White space as the patterns of the rank files mean it; \s is wider in Python.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space never belongs to the words around it, but for one space before them: a text is cut here first, and equal pieces only once.
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space at an end: what stands between two spaces cannot be cut without knowing what is around it.
OPEN_END = f"^[{SPACE}]|[{SPACE}]$"
#: Bytes of text of a slice, whose distinct words are numbered, and of each of its parts, whose positions are packed in a row.
SLICE_BYTES, PART_BYTES = 48_000_000, 6_000_000
#: Documents of a part and of a slice at most, if they are short.
PART_ROWS, SLICE_ROWS = 100_000, 1_000_000
#: Bytes of text whose words or ids a task holds.
TEXT_PER_TASK = 48_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, read on the driver: a token in base 64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def word_pattern(pattern: str) -> regex.Pattern:
    """The pattern with the white space of SPACE."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: of all neighbours whose union has a rank the lowest, leftmost first, is merged until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # pieces by where they start: the end of each, the start of the one before
    found = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(found)
    while found:
        _, i, stop = heapq.heappop(found)
        middle = end[i]
        # stale unless the two pieces still are what they were
        if middle >= stop or middle == 0 or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(found, (rank, i, end[stop]))
        if i:
            rank = ranks.get(word[before[i] : stop])
            if rank is not None:
                heapq.heappush(found, (rank, before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


@dataclass
class Slice:
    """Some megabytes of documents as words: piece i of a text is words flat[starts[i]:starts[i + 1]], sequence has the pieces of all documents
    one after another, and ends where each document's stop."""

    words: pa.Array
    flat: np.ndarray
    starts: np.ndarray
    sequence: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, pattern: regex.Pattern) -> Slice:
        """Texts are cut at single spaces, all at once; where white space stands beside a space, or at an end of the text, by the pattern
        of pieces. Equal pieces are cut into words once; a run of letters is one word, with its space."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy()[1:].astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        between = pc.dictionary_encode(lists.flatten())
        del lists
        kinds = between.dictionary
        open_ended = pc.or_(pc.equal(kinds, ""), pc.match_substring_regex(kinds, OPEN_END)).to_numpy(zero_copy_only=False)
        sequence = between.indices.to_numpy()
        odd = np.flatnonzero(open_ended[sequence])
        # twice what stands between spaces, one more for the first of a text, which has no space before
        sequence = sequence * np.int32(2)
        del between
        sequence[begins[begins < ends]] += 1
        at_odds = np.unique(np.searchsorted(ends, odd, "right"))
        pieces: dict[str, int] = {}
        if at_odds.size:
            runs, stop, lengths = [], 0, ends - begins
            for i in at_odds.tolist():
                own = [pieces.setdefault(x, len(pieces)) for x in PIECE.findall(texts[i].as_py())]
                runs += [sequence[stop : begins[i]], 2 * len(kinds) + np.array(own, np.int32)]
                stop, lengths[i] = ends[i], len(own)
            sequence, ends = np.concatenate([*runs, sequence[stop:]]), np.cumsum(lengths)
        used = np.flatnonzero(np.bincount(sequence, minlength=2 * len(kinds) + len(pieces)))
        plain, own = used[used < 2 * len(kinds)], used[used >= 2 * len(kinds)]
        text = kinds.take(pa.array(plain // 2))
        text = pc.if_else(pa.array(plain % 2 == 1), text, pc.binary_join_element_wise(" ", text, ""))
        letters = pc.utf8_is_alpha(kinds).to_numpy(zero_copy_only=False)[plain // 2]
        one, names = text.filter(pa.array(letters)), list(pieces)
        several = [pattern.findall(x) for x in text.filter(pa.array(~letters)).to_pylist() + [names[i - 2 * len(kinds)] for i in own.tolist()]]
        order = np.concatenate([plain[letters], plain[~letters], own])
        place = np.empty(2 * len(kinds) + len(pieces), np.int32)
        place[order] = np.arange(order.size)
        coded = pc.dictionary_encode(pa.concat_arrays([one, pa.array([w for words in several for w in words], pa.string())]))
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.ones(len(one), np.int64), np.array([len(x) for x in several], np.int64)]))])
        return cls(coded.dictionary, coded.indices.to_numpy(), starts, place[sequence], ends)

    def ranks(self) -> np.ndarray:
        """The words' numbers by falling frequency: those pack better."""
        often = np.bincount(self.sequence, minlength=self.starts.size - 1)
        counts = np.bincount(self.flat, np.repeat(often, np.diff(self.starts)), len(self.words))
        ranks = np.empty(len(self.words), np.int64)
        ranks[np.argsort(-counts, kind="stable")] = np.arange(len(self.words))
        return ranks

    def positions(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Of documents first to last (exclusive): the word at every position, and where each document ends."""
        begin = self.ends[first - 1] if first else 0
        codes, counts = spread(self.flat, self.starts, self.sequence[begin : self.ends[last - 1]])
        return codes, np.concatenate([[0], counts])[self.ends[first:last] - begin]


def spread(values: np.ndarray, starts: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[starts[i]:starts[i + 1]] for each i of sequence, one after another, and the running count of values."""
    lengths = (starts[1:] - starts[:-1])[sequence]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if ends.size else 0) + np.repeat(starts[:-1][sequence] - ends + lengths, lengths)
    return values[at], ends


def pack_codes(codes: np.ndarray) -> list[bytes]:
    """Byte by byte of the numbers, compressed: frequent words have small ones, so the high bytes are mostly zero."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [pa.compress(np.ascontiguousarray(planes[:, i]), "zstd", asbytes=True) for i in range(4)] if codes.size else []


def unpack_codes(planes: list[bytes], n: int) -> np.ndarray:
    whole = np.zeros((n, 4), np.uint8)
    for i, plane in enumerate(planes):
        whole[:, i] = np.frombuffer(pa.decompress(plane, n, "zstd", asbytes=True), np.uint8)
    return whole.reshape(-1).view("<u4").astype(np.int64)


def cuts(sizes: np.ndarray, most: int, rows: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most `rows` and about `most` bytes; a range ends with the row that reaches it."""
    ends, out, first, total = np.cumsum(sizes), [], 0, 0
    while first < sizes.size:
        last = min(int(np.searchsorted(ends, total + most)) + 1, first + rows, sizes.size)
        out.append((first, last))
        first, total = last, ends[last - 1]
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Numbered slices of a task's documents (_id, _text, _part), whatever its batches are: (number, ids, texts)."""
    part, seq, held, size, n = 0, 0, [], 0, 0

    def whole() -> tuple[int, pa.Array, pa.Array]:
        return part << 32 | seq, pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x for _, x in held])

    for batch in batches:
        part = batch.column(2)[0].as_py() if batch.num_rows else part
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        while first < batch.num_rows:
            last = cuts(sizes[first:], SLICE_BYTES - size, SLICE_ROWS - n)[0][1] + first
            held.append((batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)))
            size, n = size + int(sizes[first:last].sum()), n + last - first
            first = last
            if size >= SLICE_BYTES or n >= SLICE_ROWS:
                yield whole()
                held, size, n, seq = [], 0, 0, seq + 1
    if held:
        yield whole()


def _rows(names: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def slice_words(source: DataFrame, pattern: str) -> DataFrame:
    """(word, slice, code): the distinct words of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _slices(batches):
            now = Slice.of(texts, word_pattern(pattern))
            words, ranks = now.words.cast(pa.binary()), pa.array(now.ranks(), pa.int32())
            del now, texts
            pa.default_memory_pool().release_unused()
            for at in range(0, len(words), 50_000):
                own = words.slice(at, 50_000)
                yield _rows("word slice code", own, pa.array(np.full(len(own), number)), ranks.slice(at, 50_000))

    return source.mapInArrow(run, "word binary, slice long, code int")


def slice_positions(source: DataFrame, pattern: str) -> DataFrame:
    """(slice, code, ids, head), code and ids null: which words each part of a slice has where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _slices(batches):
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            now = Slice.of(texts, word_pattern(pattern))
            ranks = now.ranks()
            del texts
            pa.default_memory_pool().release_unused()
            for first, last in cuts(sizes, PART_BYTES, PART_ROWS):
                codes, ends = now.positions(first, last)
                table = pa.table({"id": ids.slice(first, last - first)})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(table)
                head = pickle.dumps((len(ranks), codes.size, pack_codes(ranks[codes]), pack_gaps(ends), sink.getvalue().to_pybytes()), protocol=5)
                yield _rows("slice code ids head", pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([head], pa.binary()))

    return source.mapInArrow(run, "slice long, code int, ids binary, head binary")


class Answers:
    """The ids of a slice's words, in the order of their numbers."""

    def __init__(self, width: np.dtype):
        self.width, self.lists, self.n = width, [], 0

    def add(self, lists: pa.Array) -> None:
        self.lists.append(lists)
        self.n += len(lists)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each word start."""
        whole = pa.concat_arrays([pa.array([], pa.binary()), *self.lists])
        offsets = np.frombuffer(whole.buffers()[1] or b"\0" * 4, np.int32, self.n + 1, 4 * whole.offset).astype(np.int64)
        n = int(offsets[-1] - offsets[0]) // self.width.itemsize
        values = np.frombuffer(whole.buffers()[2], self.width, n, offsets[0]) if n else np.zeros(0, self.width)
        return values, (offsets - offsets[0]) // self.width.itemsize


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str) -> tuple[DataFrame, Callable, str]:
    """Answers and positions by slice, what makes (doc_id, ids) of them, and its schema."""
    spark = docs.sparkSession
    # a task's own number would depend on what else its stage reads
    source = with_text(docs, id_col, text_col).withColumn("_part", F.spark_partition_id())
    shared = spark.sparkContext.broadcast(ranks)
    n_tasks = parts(spark, text_bytes(source), TEXT_PER_TASK)
    width = np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, b""
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, ids = word, np.array(merge(word, shared.value), width).tobytes()
                found.append(ids)
            yield _rows("slice code ids head", batch.column(1), batch.column(2), pa.array(found, pa.binary()), pa.nulls(batch.num_rows, pa.binary()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known, table = None, Answers(width), None
        for batch in batches:
            numbers, codes = batch.column(0).to_numpy(), batch.column(1)
            for a, b in zip(*runs_of(numbers, codes.is_null().to_numpy(zero_copy_only=False)), strict=True):
                if numbers[a] != number:
                    number, known, table = numbers[a], Answers(width), None
                if codes[a].is_valid:
                    known.add(batch.column(2).slice(a, b - a))
                    continue
                for head in batch.column(3).slice(a, b - a):
                    n_words, n_codes, planes, ends, stream = pickle.loads(head.as_py())
                    if known.n != n_words:
                        raise RuntimeError(f"{known.n} answers to {n_words} words: the documents came in another order when a task was repeated")
                    table = table or known.table()
                    tokens, counts = spread(*table, unpack_codes(planes, n_codes))
                    bounds = np.concatenate([[0], np.concatenate([[0], counts])[unpack_gaps(ends)]])
                    with pa.ipc.open_stream(stream) as reader:
                        names = reader.read_all().column("id").combine_chunks()
                    names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
                    yield _rows("doc_id ids", names, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens.astype(np.int32))))

    reply = "slice long, code int, ids binary, head binary"
    answers = slice_words(source, pattern).repartition(n_tasks, "word").sortWithinPartitions("word").mapInArrow(answer, reply)
    every = answers.unionAll(slice_positions(source, pattern)).repartition(n_tasks, "slice")
    # of a slice, the answers in order, then its parts
    ordered = every.sortWithinPartitions("slice", F.col("code").asc_nulls_last())
    return ordered, gather, f"doc_id {source.schema['_id'].dataType.simpleString()}, ids array<int>"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. pattern: the pre-tokens; a run of letters with or without a space before is one, and white space
    ends before a word or its one space."""
    ordered, gather, schema = _encoded(docs, ranks, pattern, id_col, text_col)
    return ordered.mapInArrow(gather, schema)


def runs_of(*keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of rows that agree in all keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new).tolist()
    return starts, [*starts[1:], len(new)]


def _decoder(spark: SparkSession, ranks: dict[bytes, int], ids_col: str, bytes_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the bytes of ids to batches."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens if tokens is not None else pa.array(shared.value, pa.binary())
            lists = batch.column(batch.schema.get_field_index(ids_col))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            known = np.isfinite(flat) & (flat >= 0) & (flat < len(tokens))
            joined = tokens.take(pa.array(np.where(known, flat, 0).astype(np.int64))) if len(tokens) else pa.nulls(len(flat), pa.binary())
            bad = np.concatenate([[0], np.cumsum(~known | joined.is_null().to_numpy(zero_copy_only=False))])
            lengths = np.array(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(lengths)
            joined = joined.fill_null(b"")
            places = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset) if len(joined) else np.zeros(1, np.int32)
            whole = memoryview(joined.buffers()[2]) if len(joined) else b""
            out = [None if bad[e] > bad[e - n] or not ok else bytes(whole[places[e - n] : places[e]]) for e, n, ok in zip(ends.tolist(), lengths.tolist(), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, bytes_col])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The rows of encoded with the bytes of their ids: a join with the token-byte table that every task has."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoder(encoded.sparkSession, ranks, ids_col, bytes_col), f"{schema}, `{bytes_col}` binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encode, then decode, in one worker's hands."""
    ordered, gather, schema = _encoded(docs, ranks, pattern, id_col, text_col)
    decoder = _decoder(docs.sparkSession, ranks, "ids", "decoded")
    decoded = ordered.mapInArrow(lambda batches: decoder(gather(batches)), f"{schema}, decoded binary")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
