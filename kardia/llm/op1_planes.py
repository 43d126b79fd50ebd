"""Token ids in bit-plane or byte-plane shuffled, zstandard-compressed chunks with a chunk index.

File format: a Parquet table whose rows are chunks. The ids of one ``segment`` (a
range of doc_ids, ascending) are one sequence, cut into chunks of
``CHUNK_IDS`` ids. A chunk is stored as planes: plane k of byte shuffling holds
byte k of every id (little-endian unsigned 32 bits), plane k of bit shuffling
holds bit k of every id, eight to a byte. Each plane is a zstandard frame of its own,
so a reader inflates just the planes and chunks it wants. A second table, the
chunk index, has a row per chunk without payload: its place in the segment, the
sizes of its planes, and the documents (or pieces of them) that lie in it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from kardia.llm.chunks import Memo
from kardia.llm.common import arrow_schema, bounded_batches, documents, map_rows, materialise, ordered_buckets, scratch

CHUNK_IDS = 1 << 16
BATCH_ROWS = 1500  # documents encoded together: more share more words
LEVEL = 3
END_ID = 2
WORD = re.compile(r"[ \n]\S+")
TOGETHER = 250  # chunks that the library gets as one text
TOKENIZER = "byte_bpe_50k.json"

CHUNKS = """segment long, chunk long, first long, n_ids long, layout string, plane_bytes array<int>, planes binary,
            docs array<struct<doc_id:long,start:long,from:long,n:long,piece:long,last:boolean>>"""


def shuffle(ids: np.ndarray, layout: str = "byte") -> list[bytes]:
    """Planes of an array of ids (unsigned, 32 bits)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if layout == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    if layout == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    raise ValueError(f"no such layout: {layout}")


def unshuffle(planes: list[bytes], n: int, layout: str = "byte") -> np.ndarray:
    if layout == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")[:n]
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def tokenizer_memo(name: str = TOKENIZER) -> Memo:
    """The tokenizers library's encoder over distinct chunks; ids come as little-endian 32-bit bytes."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task; Spark deals out the work
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))

    vocab = tok.get_vocab()
    leads = np.zeros(max(vocab.values(), default=0) + 1, bool)
    leads[[i for t, i in vocab.items() if t[0] in "\u0120\u010a"]] = True  # a space or a line break first

    def encode(chunks: list[str]) -> list[bytes]:
        """Chunks of one word that begin with a space or a line break are encoded many at a time: each has just one token that does."""
        out: list = [None] * len(chunks)
        words = [i for i, c in enumerate(chunks) if WORD.fullmatch(c)]
        groups = [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, tok.encode_batch_fast(["".join([chunks[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(array("I", e.ids), "<u4")
            starts = np.flatnonzero(leads[ids])
            if len(starts) == len(group):
                raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                for i, a, b in zip(group, cuts, cuts[1:]):
                    out[i] = raw[a:b]
        alone = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(alone, tok.encode_batch_fast([chunks[i] for i in alone], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    return Memo(encode)


_memo: dict[str, Memo] = {}


def encode_texts(texts: list[str], name: str = TOKENIZER, end_id: int | None = END_ID) -> list[bytes]:
    """Ids of each text as little-endian 32-bit bytes, with the end id; the worker keeps its chunk memo between tasks."""
    if name not in _memo:
        _memo[name] = tokenizer_memo(name)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    return [ids.tobytes() + end for ids in _memo[name].ids(texts)]


class ChunkWriter:
    """Cuts a sequence of documents into chunks."""

    def __init__(self, segment: int, layout: str, chunk_ids: int):
        self.segment, self.layout, self.size = segment, layout, chunk_ids
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.number = self.first = 0  # of the chunk at hand
        self.buffer, self.held, self.docs = [], 0, []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        at, piece, n, start = 0, 0, len(ids) // 4, self.first + self.held
        while at < n:
            take = min(self.size - self.held, n - at)
            self.docs.append({"doc_id": doc_id, "start": start, "from": self.held, "n": take, "piece": piece, "last": at + take == n})
            self.buffer.append(ids[4 * at:4 * (at + take)])
            self.held, at, piece = self.held + take, at + take, piece + 1
            if self.held == self.size:
                yield self.flush()

    def flush(self) -> dict:
        frames = [self.packer.compress(p) for p in shuffle(np.frombuffer(b"".join(self.buffer), "<u4"), self.layout)]
        row = {"segment": self.segment, "chunk": self.number, "first": self.first, "n_ids": self.held, "layout": self.layout,
               "plane_bytes": [len(f) for f in frames], "planes": b"".join(frames), "docs": self.docs}
        self.number, self.first = self.number + 1, self.first + self.held
        self.buffer, self.held, self.docs = [], 0, []
        return row


def read_chunk(planes: bytes, plane_bytes: list[int], n_ids: int, layout: str) -> np.ndarray:
    unpack, at, out = zstandard.ZstdDecompressor(), 0, []
    for n in plane_bytes:
        out.append(unpack.decompress(planes[at:at + n]))
        at += n
    return unshuffle(out, n_ids, layout)


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", layout: str = "byte", chunk_ids: int = CHUNK_IDS, name: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write ids in ascending doc_id order: ``path/chunks`` and the chunk index ``path/index``.

    Null and empty texts have just the end id. Repeated ids keep all their rows,
    by text. A null id comes first. An empty table writes empty files.
    """
    bounded_batches(docs.sparkSession, BATCH_ROWS)
    dealt, bounds = ordered_buckets(documents(docs, id_col, text_col))
    dealt = dealt.repartitionByRange(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    schema = StructType.fromDDL(CHUNKS)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = None, []
        for b in batches:
            cols = b.to_pydict()
            for segment, doc_id, ids in zip(cols["bucket"], cols["doc_id"], encode_texts(cols["text"], name, end_id)):
                if writer is None or writer.segment != segment:
                    made += [writer.flush()] if writer and writer.held else []
                    writer = ChunkWriter(segment, layout, chunk_ids)
                made += writer.add(doc_id, ids)
            if len(made) >= 4:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
                made = []
        made += [writer.flush()] if writer and writer.held else []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    dealt.mapInArrow(run, schema).write.parquet(f"{path}/chunks")
    chunks = docs.sparkSession.read.schema(schema).parquet(f"{path}/chunks")
    chunks.drop("planes").write.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the chunks alone.

    Each chunk is inflated where it lies; a document that spans chunks has its
    pieces' checksums combined, so no task needs more than a chunk at a time.
    """
    bounded_batches(spark)
    # ids before each segment; there are as many segments as partitions were written
    totals = spark.read.parquet(f"{path}/index").groupBy("segment").agg(F.sum("n_ids").alias("n"))
    before = totals.select("segment", (F.sum("n").over(Window.orderBy("segment")) - F.col("n")).alias("before"))
    offsets = {r.segment: r.before for r in before.toLocalIterator()}

    def checksums(cols):
        out = {c: [] for c in ("doc_id", "start", "piece", "n", "crc", "whole")}
        for segment, n_ids, layout, sizes, planes, docs in zip(*(cols[c] for c in ("segment", "n_ids", "layout", "plane_bytes", "planes", "docs"))):
            raw = read_chunk(planes, sizes, n_ids, layout).tobytes()
            for d in docs:
                out["doc_id"].append(d["doc_id"])
                out["start"].append(offsets[segment] + d["start"])
                out["piece"].append(d["piece"])
                out["n"].append(d["n"])
                out["crc"].append(zlib.crc32(raw[4 * d["from"]:4 * (d["from"] + d["n"])]))
                out["whole"].append(d["piece"] == 0 and d["last"])
        return out

    def whole(cols):
        crcs = []
        for pieces in cols["pieces"]:
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = crc32_combine(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        return {"doc_id": cols["doc_id"], "start": cols["start"], "n_tokens": [sum(p["n"] for p in ps) for ps in cols["pieces"]], "ids_crc32": crcs}

    chunks = spark.read.schema(StructType.fromDDL(CHUNKS)).parquet(f"{path}/chunks")
    pieces = materialise(map_rows(chunks, checksums, "doc_id long, start long, piece long, n long, crc long, whole boolean"), "planes-read")
    alone = pieces.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    by_document = pieces.where("NOT whole").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"))
    return alone.unionByName(map_rows(by_document, whole, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, piece, ids)``: the ids themselves, a row for each piece of a document."""
    def run(cols):
        out = {c: [] for c in ("doc_id", "segment", "start", "piece", "ids")}
        for segment, n_ids, layout, sizes, planes, docs in zip(*(cols[c] for c in ("segment", "n_ids", "layout", "plane_bytes", "planes", "docs"))):
            ids = read_chunk(planes, sizes, n_ids, layout)
            for d in docs:
                for c, v in (("doc_id", d["doc_id"]), ("segment", segment), ("start", d["start"]), ("piece", d["piece"]), ("ids", ids[d["from"]:d["from"] + d["n"]].tolist())):
                    out[c].append(v)
        return out

    chunks = spark.read.schema(StructType.fromDDL(CHUNKS)).parquet(f"{path}/chunks")
    return map_rows(chunks, run, "doc_id long, segment long, start long, piece long, ids array<long>")


def crc32_combine(first: int, second: int, n: int) -> int:
    """The CRC-32 of two strings in a row from theirs and the length of the second, by squaring the matrix of a zero bit."""
    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    n *= 8
    while n:
        if n & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        n >>= 1
    return first ^ second


def planes_roundtrip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` in the chunk format below the shared scratch folder and read every document back from there."""
    path = scratch(docs.sparkSession, "planes")
    write_ids(docs, path, **options)
    return read_documents(docs.sparkSession, path)
