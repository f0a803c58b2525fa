"""Token-ID records: length-delimited binary files with masked checksums, and an offset index.

A file is a sequence of records: length (8 bytes, little endian), masked CRC of the length (4), payload,
masked CRC of the payload (4). The CRC is CRC-32 and its mask rotates it right by 15 bits and adds
0xa282ead8, so that checksums of data that holds checksums stay sound. A payload is one byte, the width of
an id (2 or 4, by the vocabulary), and the ids in little endian. The index, a table beside the files, has
file, offset, size, doc_id and the number of ids before each record, so shuffled reads seek directly.

Files are written through ``pyarrow.fs``, so the folder may be local to all, HDFS or an object store. A task
that runs again writes a file of another name; only files that the index names count.
"""

import re
import string
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from corpusgraph.functions.tables import new_path, written

from .text import small

END_ID = 1
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ENCODERS = {}
#: Words, and words without case and closing marks, whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED, PARTS = 200_000, 1_000_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: bytes, offset: int = 0) -> bytes:
    """Payload of the record at ``offset``; raises ValueError if a checksum is wrong or the record is cut."""
    head = data[offset:offset + 8]
    if len(head) < 8 or data[offset + 8:offset + 12] != struct.pack("<I", masked(head)):
        raise ValueError(f"broken length at {offset}")
    end = offset + 12 + struct.unpack("<Q", head)[0]
    payload = data[offset + 12:end]
    if data[end:end + 4] != struct.pack("<I", masked(payload)):
        raise ValueError(f"broken record at {offset}")
    return payload


class _Words(dict):
    """Word -> ids as packed bytes, filled on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.parts = encode, {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            got = self.parts[part] = self.encode(part)
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        body = word.rstrip(string.punctuation)
        # a letter that normalising turns into a letter and a combining mark does not end a run of marks
        if not body[-1:].isalnum() or len(unicodedata.normalize("NFC", body[-1].lower())) > 1:
            body = word
        tail = word[len(body):]
        got = self._part(body.lower() if body.isascii() else body) + (self._part(tail) if tail else b"")
        self[word] = got
        return got


class Encoder:
    """Ids of whole texts as packed little-endian bytes.

    The tokenizer splits at white space and between letters or digits and marks before anything else, and no
    step of it looks across, so a text's ids are its words' ids in order, and a word's are those of its body and
    its closing marks; each is encoded once and remembered. Texts with one of the tokenizer's own added strings,
    or with control characters that Python takes for space, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end = np.array([END_ID], self.kind).tobytes()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        find = self.words.__getitem__
        return [(self._whole(t) if any(a in t for a in self.added) or _ODD_SPACE.search(t) else b"".join(map(find, t.split()))) + self.end for t in texts]


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, folder: str = None) -> DataFrame:
    """Write ``docs`` (doc_id, text, ...) in ascending doc_id order; returns the index.

    ``tokenizer`` is the path of a tokenizer file on every machine. Equal ids are ordered by text, null ids
    come first, a null text is empty (its record holds the end id alone). Index columns: file (number in
    order), path, place (in the file), doc_id, offset, size, n_tokens, start (ids of all records before).
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    schema = pa.schema([("file", pa.int32()), ("path", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()),
                        ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])

    def run(batches):
        encode, out, path, offset, place, before = _encoder(tokenizer), None, None, 0, 0, 0
        for batch in small(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = []
            if out is None:
                store, at = fs.FileSystem.from_uri(folder)
                store.create_dir(at)
                path = f"{at}/{batch.column('file')[0].as_py():06d}-{uuid.uuid4().hex}.records"
                out = store.open_output_stream(path)
            for doc_id, packed in zip(ids, encode(batch.column("text").to_pylist())):
                record = framed(bytes([encode.kind.itemsize]) + packed)
                out.write(record)
                n = len(packed) // encode.kind.itemsize
                rows.append((place, doc_id, offset, len(record), n, before))
                place, offset, before = place + 1, offset + len(record), before + n
            named = path.rsplit("/", 1)[1]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("file").cast(pa.int32()), pa.array([named] * len(rows)), *(pa.array(c, pa.int64()) for c in cols)], schema=schema)
        if out is not None:
            out.close()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").select(F.spark_partition_id().alias("file"), "doc_id", "text")
    index = written(rows.mapInArrow(run, "file int, path string, place long, doc_id long, offset long, size long, n_tokens long, before long"), "record-index")
    # one row per file: ids of all files before it
    ahead = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return index.join(ahead, "file").select("file", F.concat(F.lit(folder + "/"), "path").alias("path"), "place", "doc_id", "offset", "size", "n_tokens",
                                            (F.col("before") + F.col("ahead")).alias("start"))


def read(index: DataFrame) -> DataFrame:
    """Records by their index rows (any subset, any order): doc_id, start, n_tokens, ids_crc32.

    Rows of a file are read together, by seeking; lengths and checksums are verified.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        path, data = None, None
        for batch in batches:
            out = []
            for name, doc_id, offset, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "doc_id", "offset", "size", "start"))):
                if name != path:
                    store, at = fs.FileSystem.from_uri(name)
                    path, data = name, store.open_input_file(at)
                data.seek(offset)
                payload = unframed(data.read(size))
                ids = np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1)
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=schema)
    rows = index.select("file", "path", "place", "doc_id", "offset", "size", "start")
    return rows.repartition("file").sortWithinPartitions("file", "place").drop("file", "place").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
