"""Concatenate and cut: documents packed into fixed windows of tokens, without padding but the last.

First pass: every document is tokenised once and written with its place in its partition. The
totals of the partitions, one pair of integers each, are summed on the driver into global offsets.
Second pass: each document learns its global place and is cut at the multiples of the window.
Neither pass shuffles. :func:`sequences` joins the pieces: windows inside a partition are complete
at once, and only windows that cross its edges go through a shuffle, as boundary records.

Null texts are empty (they hold the closing id alone); a null ``doc_id`` stays null; equal or repeated rows are
packed as often as they occur; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm.ragged import KeyedRows
from kerbwise.llm.words import binaries, hashes, lean, slices, utf8, words
from kerbwise.session import new_path

WINDOW = 4096
END_ID = 2
#: A letter a-z followed by one of these always ends a token of the tokenizer's own splitting.
_AFTER_LETTER = b",.;:!?)"
#: Text that a worker tokenises at a time: the arrays of a step take some 60 bytes for each of its bytes.
_SLICE_BYTES = 1 << 18
#: Byte-level spelling: printable bytes stand for themselves, the others for 256, 257 and so on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

TOKENS = "doc_id long, part long, place long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _loaded(path: str):
    # Spark runs a worker for each core; threads of its own would only hold memory beside the other workers
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), KeyedRows()


def _spelled(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS)


def _units(data: np.ndarray, offsets: np.ndarray):
    """Words, cut once more between a letter and closing punctuation."""
    starts, ends, _ = words(data, offsets)
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    closing = np.isin(data, np.frombuffer(_AFTER_LETTER, np.uint8))
    inner = np.flatnonzero(letter[:-1] & closing[1:]) + 1
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    inner = inner[~row_start[inner]]
    starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends, np.searchsorted(starts, offsets)


def token_ids(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each row and their offsets.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of
    its words in turn; each distinct word is encoded once and then looked up. A word of small
    Latin letters is one token of its splitting, so it goes to the tokenizer's model directly.
    """
    tokenizer, known = _loaded(path)
    starts, ends, unit_offsets = _units(data, offsets)
    raw = data.tobytes()
    exact = b"<|" in raw  # a special token's string counts only in its own spelling
    keys = hashes(data, starts, ends, lower=not exact) ^ np.uint64(exact)

    def make(first: np.ndarray):
        texts = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        found: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            text = text if exact else text.lower() if text.isascii() else text
            if text.isalpha() and max(text) < "\u0250" and text == text.lower():
                found[i] = [t.id for t in tokenizer.model.tokenize(_spelled(text))]
            else:
                rest.append(i)
        for i, x in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = x.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    if not len(keys):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    ids, lengths = known.rows(keys, make)
    return ids, np.concatenate(([0], np.cumsum(lengths)))[unit_offsets]


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(batch.num_rows, np.diff(utf8(column)[1]), _SLICE_BYTES):
                data, offsets = utf8(column.slice(a, b - a))
                ids, ends = token_ids(path, data, offsets)
                ids = np.insert(ids, ends[1:], END_ID).astype("<u4")
                ends = ends + np.arange(len(ends))
                counts = np.diff(ends)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                        "part": pa.array(np.full(b - a, part, np.int64)),
                        "place": pa.array(place + ends[:-1].astype(np.int64)),
                        "n_tokens": pa.array(counts.astype(np.int64)),
                        "ids": binaries(ids, ends),
                    }
                )
                place += int(ends[-1])

    return run


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """Every document's ids, little-endian 32-bit, with its place in its partition."""
    return docs.select("doc_id", "text").mapInArrow(lean(_tokenised(path)), TOKENS)


def _cut(base: dict[int, int], window: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
            for doc, part, place, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "place", "n_tokens", "ids"))):
                at = base[part] + place
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start:4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, sequence, offset, piece if keep_ids else None)
                    for values, value in zip(out.values(), row):
                        values.append(value)
                    start += length
            yield pa.record_batch(
                {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()}
            )

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence.

    Beside the written ids, the driver holds one pair of integers for each partition of ``docs``.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "packing")
    tokenised(docs, path).write.option("compression", "zstd").parquet(folder)
    written = spark.read.schema(TOKENS).parquet(folder)
    base, total = {}, 0
    for part, tokens in sorted(tuple(r) for r in written.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base[part] = total
        total += tokens
    pieces = written.mapInArrow(lean(_cut(base, window, keep_ids)), PIECES)
    return pieces if keep_ids else pieces.drop("ids")


def _joined(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, open_offset, parts, size = None, 0, [], 0
        rows: list[tuple] = []

        def close() -> None:
            if open_id is not None:
                rows.append((open_id, open_offset, b"".join(parts)))

        for batch in batches:
            for sequence, offset, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids"))):
                if sequence != open_id or offset != open_offset + size:
                    close()
                    open_id, open_offset, parts, size = sequence, offset, [], 0
                parts.append(ids)
                size += len(ids) // 4
            yield _sequence_batch(rows)
            rows.clear()
        close()
        yield _sequence_batch(rows)

    return run


def _sequence_batch(rows: list[tuple]) -> pa.RecordBatch:
    sequence, offset, ids = zip(*rows) if rows else ((), (), ())
    return pa.record_batch(
        {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "ids": pa.array(ids, pa.binary())}
    )


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(sequence_id, ids)`` of pieces that keep their ids; ids are little-endian 32-bit.

    Windows that one partition holds in full need no shuffle. The rest are boundary records: at
    most a window of tokens for each sequence, joined in the order of their offsets.
    """
    runs = pieces.select("sequence_id", "offset", "ids").mapInArrow(
        _joined(window), "sequence_id long, offset long, ids binary"
    )
    folder = new_path(pieces.sparkSession, "sequences")
    runs.write.parquet(folder)
    runs = pieces.sparkSession.read.parquet(folder)
    whole = runs.where(F.length("ids") == 4 * window).select("sequence_id", "ids")
    parts = (
        runs.where(F.length("ids") < 4 * window)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
    return whole.unionByName(parts)
