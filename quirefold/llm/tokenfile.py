"""Token ids as files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a row of blocks. A block holds some documents that follow each other in ascending order of doc_id: their
number and that of their ids, the place of the first id among the ids of all documents, the doc_ids with a byte each
that says whether it is null, and the documents' lengths and the ids' ranks, each as control bytes (two bits a value:
its length in bytes less one) and data bytes. The commonest id has rank 0, so that most ids take one byte. The ids by
rank are in a file beside the blocks. A reader finds all lengths by looking the control bytes up in a table of 256 x 4.

The string of a special token in a text is that token, as the library has it. Null text: no ids but the end id, as for an empty one. Null doc_id comes first. Rows of the same doc_id are ordered by
text. No other column is used. An empty table gives no blocks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quirefold.llm import files
from quirefold.llm.shared import Recent, chunks, fresh_path, kept_in_worker, map_batches, stored

BLOCK_IDS = 1 << 18
#: Chunks that a worker remembers, at least.
CACHE = 500_000
HEAD = struct.Struct("<4sIQQQQ")
MAGIC = b"QFT1"
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of control and data, arrays of bytes; data may go on behind them."""
    length = _LENGTHS[control].ravel()[:n]
    at = np.zeros(n, np.int64)
    np.cumsum(length[:-1], out=at[1:], dtype=np.int64) if n else None
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(start: int, doc_ids: list, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    lc, ld = pack(lengths)
    rc, rd = pack(ranks)
    named = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is not None for x in doc_ids)
    return HEAD.pack(MAGIC, len(doc_ids), start, len(ranks), len(ld), len(rd)) + named + lc + ld + rc + rd


def read_block(src) -> tuple[int, list, np.ndarray, np.ndarray] | None:
    """Start, doc_ids, lengths and ranks of the next block of an open file."""
    head = src.read(HEAD.size)
    if not head:
        return None
    magic, docs, start, n, ld, rd = HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError("no block of token ids begins here")
    lc, rc = -(-docs // 4), -(-n // 4)
    raw = np.frombuffer(src.read(9 * docs + lc + ld + rc + rd), np.uint8)
    named, there = raw[: 8 * docs].view("<i8"), raw[8 * docs : 9 * docs]
    a = 9 * docs
    lengths = unpack(raw[a : a + lc], raw[a + lc : a + lc + ld], docs)
    b = a + lc + ld
    ranks = unpack(raw[b : b + rc], raw[b + rc :], n)
    return start, [x if t else None for x, t in zip(named.tolist(), there)], lengths, ranks


class TokenFiles(DataSource):
    """Reads (doc_id, start, n_tokens, ids) and writes blocks (start, doc_ids, lengths, ids) of a folder of token files.

    Option path: the folder. Where the reader's schema has ids as binary, they are little-endian 32-bit integers.
    """

    @classmethod
    def name(cls) -> str:
        return "quirefold_tokens"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def reader(self, schema):
        return TokenReader(self.options["path"], schema["ids"].dataType.typeName() == "binary")

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"])


class FilePart(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class TokenReader(DataSourceReader):
    def __init__(self, path: str, binary: bool):
        self.path, self.binary = path, binary

    def partitions(self):
        """A partition for each stretch of blocks, in order of their ids."""
        parts = [FilePart(x["file"], a, b) for x in sorted(files.read_manifests(self.path), key=lambda x: x["start"]) for a, b in x["parts"]]
        return parts or [FilePart("", 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        by_rank = np.frombuffer(files.read_bytes(f"{self.path}/ids-by-rank"), "<u4")
        where, name = files.at(f"{self.path}/{partition.file}")
        kind = pa.binary() if self.binary else pa.list_(pa.int32())
        with where.open_input_file(name) as src:
            src.seek(partition.begin)
            while src.tell() < partition.end and (block := read_block(src)):
                start, doc_ids, lengths, ranks = block
                ids = by_rank[ranks].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                if self.binary:
                    column = pa.Array.from_buffers(kind, len(doc_ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
                else:
                    column = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends[:-1]), pa.array(lengths.astype(np.int64)), column], ["doc_id", "start", "n_tokens", "ids"])


class Written(WriterCommitMessage):
    def __init__(self, entry: dict):
        self.entry = entry


class TokenWriter(DataSourceArrowWriter):
    """Each task writes a file of its own; the manifest, written when all have ended, names those that count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        by_rank = np.frombuffer(files.read_bytes(f"{self.path}/ids-by-rank"), "<u4")
        rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        file = files.attempt_name(".tokens")
        where, name = files.at(f"{self.path}/{file}")
        first, parts, at, out = None, [], 0, None
        for batch in iterator:
            for start, doc_ids, lengths, ids in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "lengths", "ids"))):
                out = out or where.open_output_stream(name, compression=None)
                raw = block_bytes(start, doc_ids, np.array(lengths, np.uint32), rank_of[np.frombuffer(ids, "<u4" if len(ids) == 4 * sum(lengths) else "<u2")])
                out.write(raw)
                first = start if first is None else min(first, start)
                if not parts or parts[-1][1] - parts[-1][0] > 16 << 20:
                    parts.append([at, at])
                at += len(raw)
                parts[-1][1] = at
        if out:
            out.close()
        return Written({"file": file, "start": first, "parts": parts} if out else {})

    def commit(self, messages):
        files.write_manifest(self.path, [m.entry for m in messages if m and m.entry])

    def abort(self, messages):
        files.drop_files(self.path, [m.entry["file"] for m in messages if m and m.entry])


class Chunks:
    """A worker's encoder: texts to ids by the tokenizers library, each chunk once as long as it is remembered."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        # a text that holds one of these is encoded whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        # a token of a byte-level vocabulary has a character for each byte
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.later, self.first = Recent(CACHE), Recent(CACHE // 8)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks that follow a space, many at once: where one begins is told by the bytes that tokens stand for."""
        known = self.later.now
        odd = [x for x in new if not x or x[0].isspace() or x[-1].isspace()]  # their blanks would join with others
        known.update(zip(odd, self._plain([" " + x for x in odd])))
        new = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum([len(x.encode()) + 1 for x in part])
            cut = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            known.update(zip(part, [ids[a:b].tobytes() for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        cut = [chunks("" if i in whole else t) for i, t in enumerate(texts)]
        distinct: set[str] = set()
        for _, rest in cut:
            distinct.update(rest)
        self._learn(self.later.missing(distinct))
        new = self.first.missing({x for x, _ in cut})
        self.first.now.update(zip(new, self._plain(new)))
        get, first = self.later.now.__getitem__, self.first.now
        out = [first[lead] + b"".join(map(get, rest)) for lead, rest in cut]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
            out[i] = ids
        return out


BLOCKS = "p int, before long, n long, doc_ids array<long>, lengths array<int>, ids binary"


def blocks(df: DataFrame, tokenizer: str, end_id: int, parts: int) -> DataFrame:
    """Blocks of ids in ascending order of doc_id: p says which range of doc_ids, before how many ids of it come first."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        words, p = kept_in_worker(("tokens", tokenizer), lambda: Chunks(tokenizer)), TaskContext.get().partitionId()
        end, width = np.array([end_id], words.kind).tobytes(), int(words.kind[-1])
        before, doc_ids, got, size = 0, [], [], 0

        def block():
            lengths = [len(x) // width for x in got]
            return {"p": [p], "before": [before], "n": [sum(lengths)], "doc_ids": [doc_ids], "lengths": [lengths], "ids": [b"".join(got)]}

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], words.encode(batch["text"])):
                doc_ids.append(doc_id)
                got.append(ids + end)
                size += len(ids) // width + 1
                if size >= BLOCK_IDS:
                    yield block()
                    before, doc_ids, got, size = before + size, [], [], 0
        if doc_ids:
            yield block()

    return map_batches(docs, run, BLOCKS)


def write_tokens(df: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Writes the ids of df's texts to token files in the folder path. df: doc_id, text and any other columns."""
    spark = df.sparkSession
    spark.dataSource.register(TokenFiles)
    made = stored(blocks(df, tokenizer, end_id, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ids")

    def count(batches: Iterable[dict[str, list]]):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, ids in zip(batch["n"], batch["ids"]):
                part = np.bincount(np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<u2"))
                small, large = sorted((total, part), key=len)
                large = large.copy()
                large[: len(small)] += small
                total = large
        yield {"id": np.flatnonzero(total).tolist(), "n": total[total > 0].tolist()}

    # at most a row for each id of the vocabulary
    common = map_batches(made.select("n", "ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    # a row for each of the write's partitions
    sizes = {r.p: r.n for r in made.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    at, place = 0, {}
    for p in sorted(sizes):
        place[p], at = at, at + sizes[p]
    where, name = files.at(path)
    where.create_dir(name)
    files.write_bytes(f"{path}/ids-by-rank", np.array([r.id for r in common], "<u4").tobytes())
    starts = F.create_map(*[F.lit(x) for kv in place.items() for x in kv]) if place else F.create_map(F.lit(0), F.lit(0))
    made.select((starts[F.col("p")] + F.col("before")).cast("long").alias("start"), "doc_ids", "lengths", "ids").write.format("quirefold_tokens").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the token files in path; start: ids of all documents before it."""
    spark.dataSource.register(TokenFiles)
    reader = spark.read.format("quirefold_tokens")
    return (reader.schema("doc_id long, start long, n_tokens long, ids binary") if binary else reader).load(path)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids, reads the files back and returns each document's place, number and checksum of ids."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path, binary=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
