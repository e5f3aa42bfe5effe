"""Token ids as Arrow stream files of equal-length sequences and masks.

Documents are range-partitioned by id and sorted, each partition is tokenised
and written as one shard, and the shards are listed in a manifest in order.  A
shard is an Arrow stream of record batches that all have ``rows`` sequences (the
last may have fewer), each a fixed-size list of ``seq_len`` ids and a mask of
the same length, so a memory-mapped shard gives any sequence without a copy.
Beside it lies a small index of its documents' places.

A task writes under a name of its own attempt and only then returns the shard's
manifest row; what a lost attempt left is in no manifest and never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.batches import slices
from marlstone.llm.bpe import Cutter, Known, Tables, byte_letters, tables, unlike, word_bpe_path
from marlstone.llm.common import materialise, scratch, table

MANIFEST = "shard int, path string, index string, n_docs long, n_tokens long, n_sequences long"
_INDEX = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_PLACES = pa.schema([("byte", pa.int64())])


def _sequences(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Encoder:
    """The ``tokenizers`` library, asked once for each word it hasn't seen.

    A file of the form that ``bpe.unlike`` accepts is cut into words here, and
    the library's BPE model gets each new word: its own normaliser keeps
    alignments that nobody needs and takes most of its time.  For any other
    file the library gets whole texts.
    """

    def __init__(self, spec: str, found: Tables):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.known = None
        if unlike(json.loads(spec)) is None:
            self.cutter, self.letters = Cutter(spec, found), byte_letters()
            self.known = Known(self.cutter, self._words)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ask, letter = self.tokenizer.model.tokenize, self.letters.__getitem__
        ids = [[t.id for t in ask("".join(map(letter, w)))] for w in words]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text in order, in parts; whether a part is the text's last."""
        if self.known is None:
            for text in texts:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype), True
            return
        for group in self.cutter.groups(texts):
            ids, stops = self.known.flat([part for _, part, _ in group])
            ids, ends = ids.astype(self.dtype), stops.tolist()
            for (_, _, last), lo, hi in zip(group, [0, *ends], ends):
                yield ids[lo:hi], last

    def rest(self) -> None:
        """Let go of the known words: an idle worker shouldn't hold them."""
        if self.known:
            self.known.clear()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(spec: str, found: Tables) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec, found)
    return _ENCODERS[key]


class ShardWriter:
    """Cuts a stream of ids into equal sequences; holds one record batch at most.

    Beside the shard it writes the index: the places of the documents, and last
    the byte places of the record batches, so that any store can be read by
    seeking.
    """

    def __init__(self, base: str, dtype: np.dtype, seq_len: int, rows: int):
        self.fs, path = _open(f"{base}.arrow")
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.seq_len, self.rows, self.dtype = seq_len, rows, dtype
        self.schema = _sequences(dtype, seq_len)
        self.sink = self.fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.n_held, self.n_sequences, self.n_tokens = [], 0, 0, 0
        self.docs_sink = self.fs.open_output_stream(_open(f"{base}.docs")[1])
        self.docs_out = pa.ipc.new_stream(self.docs_sink, _INDEX)
        self.spans, self.n_docs, self.begun, self.batches = [], 0, 0, []

    def add(self, ids: np.ndarray) -> None:
        """Append ids to the document that is open."""
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= self.seq_len * self.rows:
            self._flush(False)

    def end(self, doc: int | None) -> None:
        """Close the open document."""
        self.spans.append((doc, self.begun, self.n_tokens - self.begun))
        self.begun = self.n_tokens
        self.n_docs += 1
        if len(self.spans) >= 65536:
            self._index()

    def _index(self) -> None:
        cols = [pa.array([s[k] for s in self.spans], pa.int64()) for k in range(3)]
        self.docs_out.write_batch(pa.RecordBatch.from_arrays(cols, schema=_INDEX))
        self.spans = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([np.empty(0, self.dtype), *self.held])
        full = self.seq_len * self.rows
        take = len(flat) // full * full
        for at in range(0, take, full):
            self._write(flat[at : at + full], full)
        rest = flat[take:]
        if last and len(rest):
            self._write(np.pad(rest, (0, -len(rest) % self.seq_len)), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.copy()], len(rest)

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.batches.append(self.sink.tell() or self.schema.serialize().size)  # the schema goes out with the first batch
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (flat, mask)], schema=self.schema))
        self.n_sequences += len(flat) // self.seq_len

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        if self.spans:
            self._index()
        self.docs_out.close()
        with pa.ipc.new_stream(self.docs_sink, _PLACES) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(self.batches, pa.int64())], schema=_PLACES))
        self.docs_sink.close()


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, seq_len: int = 1024, rows: int = 64) -> DataFrame:
    """Tokenise whole texts and write shards below ``uri``; returns the manifest.

    Documents are in ascending id order through all shards, each closed by
    ``end_id``.  Null text is empty and gives the end id alone.  Rows without an
    id come first; rows with the same id follow each other in order of text, so
    repeated rows are repeated documents.  Other columns are ignored.  An empty
    table gives an empty manifest.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), tables()))
    chosen = (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc").sortWithinPartitions("doc", "text")
    )

    def run(batches):
        coder, task = _encoder(*spec.value), TaskContext.get()
        base = f"{uri}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        writer, end = None, np.array([end_id], dtype=coder.dtype)
        for whole in batches:
            for batch in slices(whole, 1, 4096, 4_000_000):
                writer = writer or ShardWriter(base, coder.dtype, seq_len, rows)
                docs = iter(batch.column(0).to_pylist())
                for ids, last in coder.encode(batch.column(1).to_pylist()):
                    writer.add(ids)
                    if last:
                        writer.add(end)
                        writer.end(next(docs))
        coder.rest()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": task.partitionId(), "path": f"{base}.arrow", "index": f"{base}.docs",
                "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_sequences": writer.n_sequences,
            }], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    return materialise(chosen.mapInArrow(run, MANIFEST), "manifest")


class Shard:
    """Random access to a shard: mapped where the file is local, else read batch by batch by seeking."""

    def __init__(self, path: str, index: str):
        ifs, ipath = _open(index)
        with ifs.open_input_stream(ipath) as f:
            self.docs = pa.ipc.open_stream(f).read_all()
            self.places = pa.ipc.open_stream(f).read_all().column(0).to_pylist()
        fs, local = _open(path)
        self.source = pa.memory_map(local) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(local)
        self.schema = pa.ipc.read_schema(self.source)
        self.seq_len = self.schema.field("ids").type.list_size
        self.near: tuple[int, pa.RecordBatch | None] = (-1, None)
        self.rows = self.batch(0).num_rows if self.places else 1

    def batch(self, i: int) -> pa.RecordBatch:
        """Record batch ``i``; the last one asked for is kept."""
        if self.near[0] != i:
            self.source.seek(self.places[i])
            self.near = (i, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema))
        return self.near[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``, both views of the file where it is local.

        The mask is bit-packed, so its view is an Arrow array.
        """
        batch, at = self.batch(i // self.rows), i % self.rows * self.seq_len
        ids, mask = (batch.column(c).flatten().slice(at, self.seq_len) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, at: int, n: int) -> np.ndarray:
        """The ``n`` ids from place ``at`` of the shard."""
        full, out = self.rows * self.seq_len, []
        while n > 0:
            flat = self.batch(at // full).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[at % full : at % full + n]
            out.append(part)
            at, n = at + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, "<u4")


def _crc(shard: Shard, at: int, n: int, step: int = 1 << 20) -> int:
    """Of the ids as little-endian 32-bit integers, a part at a time."""
    found = 0
    for k in range(at, at + n, step):
        found = zlib.crc32(shard.ids(k, min(step, at + n - k)).astype("<u4"), found)
    return found


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before, through all shards.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = listed.select("base", "path", "index", "shard").repartitionByRange(max(1, manifest.count()), "shard").drop("shard")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["index"])
                docs, at, n = (c.to_pylist() for c in shard.docs.columns)
                crc = [_crc(shard, a, k) for a, k in zip(at, n)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([row["base"] + a for a in at], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token files and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, scratch(spark, "tokens"), word_bpe_path()))
