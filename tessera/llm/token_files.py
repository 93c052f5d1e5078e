"""Flat files of token ids with 64-bit document offsets, memory-mapped.

A data set is a folder of parts that follow one another in ascending document
id. Of each part ``p`` there are

- ``p.ids``: the ids of all its documents, one unsigned integer after another
  (16 bits where the vocabulary fits, else 32; little-endian);
- ``p.off``: unsigned 64-bit, for each document how many ids of the whole data
  set lie before it, and the end of the last one;
- ``p.doc``: for each document its id (signed 64-bit) and a byte, 1 if it is null;

and one ``parts.json`` with each part's base: the sums of the parts before it.

Parts are written by independent tasks. Each puts offsets from its own start
beside its ids and returns two numbers, its documents and its ids; the prefix
sums of these are the bases, and a second pass adds them to the offsets. A file
is written under a name of its own and then renamed, so a repeated task (a lost
executor, speculation) leaves whole files with the same content.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, shared_folder, whole_text
from tessera.llm.tokens import encoder, in_batches

DOC = np.dtype([("id", "<i8"), ("null", "u1")])
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Folder:
    """A folder on any file system that pyarrow reaches; local (or mounted) files are memory-mapped."""

    def __init__(self, uri: str):
        from pyarrow import fs

        if uri.startswith("file:"):
            uri = "/" + uri[len("file:") :].lstrip("/")
        self.system, self.root = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.system.create_dir(self.root, recursive=True)

    def temporary(self, name: str) -> str:
        return f"{self.root}/.{name}.{uuid.uuid4().hex}"

    def settle(self, temporary: str, name: str) -> None:
        self.system.move(temporary, f"{self.root}/{name}")

    def write(self, name: str, data: bytes) -> None:
        path = self.temporary(name)
        with self.system.open_output_stream(path) as out:
            out.write(data)
        self.settle(path, name)

    def bytes_of(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.root}/{name}") as data:
            return data.read()

    def array(self, name: str, dtype: np.dtype | str) -> np.ndarray:
        path = f"{self.root}/{name}"
        if self.local and self.system.get_file_info(path).size:
            return np.memmap(path, dtype=dtype, mode="r")
        return np.frombuffer(self.bytes_of(name), dtype=dtype)


class TokenFiles:
    """A written data set: ``len(files)`` documents, ``files.ids(k)`` the ids of the k-th in ascending document id."""

    def __init__(self, uri: str):
        self.folder = Folder(uri)
        self.about = json.loads(self.folder.bytes_of("parts.json"))
        self.first = [p["first_document"] for p in self.about["parts"]]

    def __len__(self) -> int:
        return self.about["documents"]

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        name = self.about["parts"][p]["name"]
        return self.folder.array(f"{name}.ids", self.about["dtype"]), self.folder.array(f"{name}.off", "<u8"), self.folder.array(f"{name}.doc", DOC)

    def ids(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        p = int(np.searchsorted(self.first, k, side="right")) - 1
        ids, offsets, _ = self.part(p)
        k -= self.first[p]
        return ids[int(offsets[k] - offsets[0]) : int(offsets[k + 1] - offsets[0])]


def write(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 20_000) -> dict:
    """Encodes every whole text, appends ``end_id``, and writes the files; returns what ``parts.json`` says.

    Null and empty texts are ``end_id`` alone. Null ids come first. Rows of one
    id are in the order of their texts' hashes, equal rows in that of the table;
    many rows of one id (or text) are dealt to as many parts as they fill. An
    empty table gives no part. Other columns are ignored. A task holds a batch
    of texts, its longest text and the remembered words.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    dtype = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_at"))
    n = buckets_for(spark, docs.count(), rows_each)
    order = ["doc_id", "_h", "_at"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        folder, name = Folder(uri), f"part-{TaskContext.get().partitionId():06d}"
        encoded, end = encoder(tokenizer).encode, np.array([end_id], dtype).tobytes()
        lengths, owners, path = [np.zeros(1, np.int64)], [], folder.temporary(name)
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or folder.system.open_output_stream(path)
            ids = batch.column("doc_id")
            owner = np.zeros(batch.num_rows, DOC)
            owner["id"], owner["null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            owners.append(owner)
            for texts in in_batches(batch.column("text").to_pylist(), 1_000_000):
                found = [np.frombuffer(x, "<u4").astype(dtype).tobytes() for x in encoded(texts)]
                lengths.append(np.array([len(x) for x in found], np.int64) // np.dtype(dtype).itemsize + 1)
                out.write(end.join([*found, b""]))
        if out:
            out.close()
            folder.settle(path, f"{name}.ids")
            ends = np.cumsum(np.concatenate(lengths))
            folder.write(f"{name}.own", ends.astype("<u8").tobytes())
            folder.write(f"{name}.doc", np.concatenate(owners).tobytes())
            yield pa.RecordBatch.from_pydict({"name": [name], "documents": [len(ends) - 1], "ids": [int(ends[-1])]})

    found = sorted(ordered.mapInArrow(encode, "name string, documents long, ids long").collect())
    bases, firsts = list(accumulate((r["ids"] for r in found), initial=0)), list(accumulate((r["documents"] for r in found), initial=0))
    parts = [{"name": r["name"], "first_document": f, "first_id": b} for r, f, b in zip(found, firsts, bases, strict=False)]

    def add_bases(batches: Iterator) -> Iterator:
        folder = Folder(uri)
        for batch in batches:
            for p in batch.column("id").to_pylist():
                own = folder.array(f"{parts[p]['name']}.own", "<u8")
                folder.write(f"{parts[p]['name']}.off", (own + np.uint64(parts[p]["first_id"])).tobytes())
            yield batch

    if parts:
        spark.range(0, len(parts), 1, min(len(parts), n)).mapInArrow(add_bases, "id long").count()
    folder = Folder(uri)
    for p in parts:
        folder.system.delete_file(f"{folder.root}/{p['name']}.own")
    about = {"dtype": dtype, "end_id": end_id, "documents": firsts[-1], "ids": bases[-1], "parts": parts}
    folder.write("parts.json", json.dumps(about).encode())
    return about


def read(spark: SparkSession, uri: str, rows_each: int = 10_000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the memory-mapped files.

    The checksum is over the ids as little-endian unsigned 32-bit integers.
    """
    parts = len(TokenFiles(uri).about["parts"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files = TokenFiles(uri)
        for batch in batches:
            for p in batch.column("id").to_pylist():
                ids, offsets, docs = files.part(p)
                for lo in range(0, len(docs), rows_each):
                    own, cuts = docs[lo : lo + rows_each], np.asarray(offsets[lo : lo + rows_each + 1]).astype(np.int64)
                    at = (cuts - int(offsets[0])).tolist()
                    data = np.asarray(ids[at[0] : at[-1]]).astype("<u4")
                    crcs = [zlib.crc32(data[a - at[0] : b - at[0]]) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own["id"], mask=own["null"].astype(bool)), pa.array(cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, ROWS)


def written_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` to a new folder in the shared one, and reads it."""
    uri = f"{shared_folder(docs.sparkSession)}/tessera/token-files-{uuid.uuid4().hex}"
    write(docs, tokenizer, uri, **options)
    return read(docs.sparkSession, uri)
