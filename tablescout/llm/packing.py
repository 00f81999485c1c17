"""Token identifiers packed into fixed-length rows, best fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import in_batches, query, table

#: A public byte-level vocabulary, on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts texts into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens in a packed row, the free identifier that ends a document, and tokens that are packed together.
LENGTH, END, SHARD_TOKENS = 2048, 50_256, 2_000_000

SCHEMA = (
    "shard long, row int, n_tokens int, doc_ids array<{id}>, piece_starts array<long>, "
    "cu_seqlens array<int>, position_resets array<int>, input_ids binary"
)


class Encoder:
    """Token identifiers of texts, as bytes of little-endian 16-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Rooms:
    """Open rows by the room they have left; a segment tree over 0..length finds the smallest room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the tightest open row with at least ``need`` left."""
        node, counts = need + self.size, self.counts
        if not counts[node]:
            # Up to the first subtree on the right that has a row, then down to its leftmost.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not counts[node]:
                    node += 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers: pieces by falling length, each into the row with the least room that holds it."""
    rooms, rows = Rooms(length), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = rooms.take(need)
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > need:
            rooms.add(room - need, row)
    return rows


def packed(ids: list, tokens: list[bytes], length: int, shard: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of one shard of documents."""
    piece_doc, piece_at, piece_len = [], [], []
    for doc, data in enumerate(tokens):
        n = len(data) // 2
        for at in range(0, n, length):
            piece_doc.append(doc)
            piece_at.append(at)
            piece_len.append(min(length, n - at))
    rows = best_fit(np.array(piece_len, np.int64), length)
    for at in range(0, len(rows), 256):
        out: dict[str, list] = {k: [] for k in ("n", "docs", "starts", "ends", "resets", "ids")}
        for pieces in rows[at : at + 256]:
            ends = np.cumsum([0] + [piece_len[p] for p in pieces])
            data = b"".join(tokens[piece_doc[p]][2 * piece_at[p] : 2 * (piece_at[p] + piece_len[p])] for p in pieces)
            out["n"].append(int(ends[-1]))
            out["docs"].append([ids[piece_doc[p]] for p in pieces])
            out["starts"].append([piece_at[p] for p in pieces])
            out["ends"].append(ends.astype(np.int32))
            out["resets"].append(ends[:-1].astype(np.int32))
            out["ids"].append(pad(data, length))
        n = len(out["n"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * n, pa.int64()),
                pa.array(range(at, at + n), pa.int32()),
                pa.array(out["n"], pa.int32()),
                pa.array(out["docs"], pa.list_(id_type)),
                pa.array(out["starts"], pa.list_(pa.int64())),
                pa.array(out["ends"], pa.list_(pa.int32())),
                pa.array(out["resets"], pa.list_(pa.int32())),
                pa.array(out["ids"], pa.binary()),
            ],
            ["shard", "row", "n_tokens", "doc_ids", "piece_starts", "cu_seqlens", "position_resets", "input_ids"],
        )


def pad(data: bytes, length: int) -> bytes:
    """Fill a row up with the end token; the tokens that count are the first n_tokens."""
    return data + np.full(length - len(data) // 2, END, "<u2").tobytes()


def written_place(docs: DataFrame) -> Column | None:
    """Where a row stands in a table that Spark has written: by the number of its part file, and by its row in it.

    None where ``docs`` is not read from files.
    """
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return (number(r"^part-(\d+)") * (1 << 40) + number(r"-c(\d+)\.") * (1 << 32)) + F.col("_metadata.row_index")


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    vocabulary: str = VOCABULARY,
    shard_tokens: int = SHARD_TOKENS,
    order: list[str] | None = None,
    place: Column | None = None,
) -> DataFrame:
    """Pack the token identifiers of all documents into rows of ``length``.

    Each task encodes its documents, ends each with END, and packs shards of about ``shard_tokens`` tokens: documents
    longer than a row are split into pieces without loss, and pieces go by falling length into the fullest row that
    still holds them. Tasks need no shuffle and hold one shard; a shard goes over the bounds of files. ``input_ids``
    is a row of the matrix, 16-bit little-endian, filled up with END; segment i of a row is cu_seqlens[i] to
    cu_seqlens[i + 1] and holds the tokens of doc_ids[i] from token piece_starts[i] on; positions start anew at each of
    position_resets.

    Shard numbers rise with the order of the rows of ``docs``, with gaps: with its partitions, so after a sort they are
    in that order. ``order`` names columns to range-sort by first. ``place`` is a number of each row that rises with
    the order where tasks read stretches of it in any order, as of a table read from files; a shard then has the place
    of its first row, and one of an eighth of its tokens or more ends where a stretch does.

    Null and empty texts are documents of the end token alone, so every row of ``docs`` is in the result, repeated
    rows and missing identifiers as well. An empty table gives no rows. Further columns are not looked at.
    """
    own = F.lit(None).cast("long") if place is None else place
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), own.alias("place"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order or [])))
    if order:
        keys = [f"o{i}" for i in range(len(order))]
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("doc_id", "text", "place", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([END], "<u2").tobytes()
        ids: list = []
        tokens: list[bytes] = []
        held, seen, shard, last, id_type = 0, 0, 0, None, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            known = batch.column(2).null_count == 0
            places = batch.column(2).to_numpy() if known else batch.column(3).to_numpy() * (1 << 40) + np.arange(seen, seen + batch.num_rows)
            # A stretch ends where the next row does not follow in the order.
            follows = np.diff(places, prepend=places[0] - 1 if last is None else last) == 1
            last = int(places[-1])
            seen += batch.num_rows
            texts = batch.column(1).to_pylist()
            for doc_id, text, at, next_one in zip(batch.column(0).to_pylist(), texts, places.tolist(), follows.tolist()):
                if held >= shard_tokens or (not next_one and held * 8 >= shard_tokens):
                    yield from packed(ids, tokens, length, shard, id_type)
                    ids, tokens, held = [], [], 0
                if not ids:
                    shard = at
                ids.append(doc_id)
                tokens.append(encode(text) + end)
                held += len(tokens[-1]) // 2
        if ids:
            yield from packed(ids, tokens, length, shard, id_type)

    return rows.mapInArrow(in_batches(run), SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def position_ids(cu_seqlens: np.ndarray, length: int) -> np.ndarray:
    """Positions of a packed row: from 0 in each segment, and from 0 in the filling."""
    edges = np.append(np.asarray(cu_seqlens), length)
    return np.arange(length) - np.repeat(edges[:-1], np.diff(edges))


def write_packed(packed: DataFrame, folder: str) -> None:
    """Write packed rows as Parquet; the rows of a shard stand in one file, in their order."""
    packed.write.mode("overwrite").parquet(folder)


def id_matrix(rows: list, length: int) -> np.ndarray:
    """The token identifiers of packed rows as a matrix."""
    return np.frombuffer(b"".join(r["input_ids"] for r in rows), "<u2").reshape(-1, length)


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
