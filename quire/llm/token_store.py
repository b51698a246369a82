"""Token ids in Parquet list columns, in document order, with selective reads.

Documents are dealt by ranges of doc_id and sorted; each range becomes one file. Ids are dictionary-coded,
documents' ids and offsets delta-coded; row groups are bounded by their tokens, pages are small, and files have column
and offset indexes. metadata() reads no token's column; documents() goes by Spark's reader, which leaves out the files that
the manifest excludes, row groups by their statistics and pages by the column index. A file's offsets start
at 0; the manifest says how many tokens stand before each file, and which documents it holds.

Tasks write through pyarrow's file systems under names of their own attempts; the manifest lists the
files that committed tasks return, so a lost executor leaves at most an unused file.

Defined results
---------------
* A null text counts as empty: its tokens are the end id alone.
* Rows of one doc_id stand together, in the order of their texts' hashes; repeated rows are all written.
  Null ids come first. An empty table makes an empty store.
* Only doc_id and text are read; others may have any name. doc_id is a long.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import byte_letters, list_column
from quire.llm.common import new_path, open_shared, parts_for, tune
from quire.llm.pretokens import Memo

END = 2
#: Tokens after which a row group is closed, and bytes of a page.
GROUP_TOKENS = 1 << 20
PAGE = 128 << 10
#: Distinct pre-tokens in a generation of a worker's memory: some 90 MB each.
KEPT = 400_000
MANIFEST = "part int, path string, tokens long, documents long, first long, last long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])
FORMAT = {
    "compression": "zstd", "compression_level": 1, "use_dictionary": ["ids.list.element"], "data_page_version": "2.0", "data_page_size": PAGE, "write_page_index": True,
    "column_encoding": {"doc_id": "DELTA_BINARY_PACKED", "start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"},
}

_memos: dict[str, Memo] = {}


def _memo(key: str, spec: str) -> Memo:
    """The worker's tokenizer and its memory, kept from batch to batch."""
    if key not in _memos:
        from tokenizers import Tokenizer

        _memos.clear()
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        _memos[key] = Memo(_bulk(tokenizer), special, KEPT)
    return _memos[key]


def _bulk(tokenizer):
    """Encode many pre-tokens with few calls.

    Pre-tokens of one blank and then no blank stay whole when they are joined, as each begins with the only
    blank near; the lengths of the tokens tell where the next begins. The others are encoded one by one.
    """
    back = {c: b for b, c in enumerate(byte_letters())}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    length = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        length[i] = sum(c in back for c in token)

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.array([len(w) > 1 and w[0] == " " and not w[1].isspace() for w in new])  # white space stands with white space alone
        plain, rest = [w for w, j in zip(new, joined, strict=True) if j], [w for w, j in zip(new, joined, strict=True) if not j]
        got = tokenizer.encode_batch_fast(["".join(plain[i : i + 100]) for i in range(0, len(plain), 100)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in got)])
        ends = np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(w.encode()) for w in plain])) + 1
        one = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        # words are numbered in the order of new, so the two kinds are put back in their places
        sizes = np.empty(len(new), np.int64)
        sizes[joined], sizes[~joined] = np.diff(ends, prepend=0), [len(x) for x in one]
        of = np.repeat(joined, sizes)
        out = np.empty(len(of), "<u4")
        out[of], out[~of] = ids, np.concatenate([np.zeros(0, "<u4"), *one])
        return out, sizes

    return encode


def _key(spec: str) -> str:
    return hashlib.sha256(spec.encode()).hexdigest()


def write(docs: DataFrame, tokenizer_path: str, path: str, end: int = END) -> None:
    """Encode docs and write the store's files to path/data and the manifest to path/manifest."""
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary's file, whatever the corpus
    key = _key(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo, part, start, documents = _memo(key, shared.value), TaskContext.get().partitionId(), 0, 0
        file, out, writer, held, size, first, last = f"{path}/data/{part:06d}-{uuid.uuid4().hex}.parquet", None, None, [], 0, None, None

        def flush() -> None:
            nonlocal held, size
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=sum(b.num_rows for b in held))
            held, size = [], 0
            pa.default_memory_pool().release_unused()

        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                out = open_shared(file, "out")
                writer = pq.ParquetWriter(out, SCHEMA, **FORMAT)
                first = b.column("doc_id")[0].as_py()
            tokens, sizes = memo.encode([t or "" for t in b.column("text").to_pylist()], end)
            starts = start + np.cumsum(sizes) - sizes
            start, size, documents, last = start + int(sizes.sum()), size + int(sizes.sum()), documents + b.num_rows, b.column("doc_id")[-1].as_py()
            held.append(pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(sizes), list_column(tokens, sizes).cast(SCHEMA.field("ids").type)], schema=SCHEMA))
            if size >= GROUP_TOKENS:
                flush()
        if writer is not None:
            flush()
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, file, start, documents, first, last), (pa.int32(), pa.string(), *(pa.int64(),) * 4), strict=True)], names=["part", "path", "tokens", "documents", "first", "last"])

    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange(parts_for(docs), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    files = sorted(rows.mapInArrow(run, MANIFEST).collect(), key=lambda r: r["part"])  # a row for each file
    before, listed = 0, []
    for r in files:
        listed.append((*r, before))
        before += r["tokens"]
    spark.createDataFrame(listed, f"{MANIFEST}, before long").coalesce(1).write.parquet(f"{path}/manifest")


def _batches(file: str, before: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    with open_shared(file, "random") as f:
        for b in pq.ParquetFile(f).iter_batches(1000, columns=columns):
            if "start" in columns:
                at = b.schema.get_field_index("start")
                b = b.set_column(at, "start", pc.add(b.column("start"), before))
            yield b


def read(spark: SparkSession, path: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "doc_id long, start long, n_tokens long, ids array<int>", columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The store's rows, or what `then` makes of their batches where they are read. Only the columns asked for are read from the files."""
    manifest = spark.read.parquet(f"{path}/manifest").select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                for rows in _batches(file, before, list(columns)):
                    yield then(rows) if then else rows

    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(run, schema)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens; no token is read."""
    return read(spark, path, schema="doc_id long, start long, n_tokens long", columns=("doc_id", "start", "n_tokens"))


def documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids of a few documents: of the pages that may hold them, no other is read."""
    wanted = [int(i) for i in ids]
    empty = spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids array<int>")
    if not wanted:
        return empty
    files = spark.read.parquet(f"{path}/manifest").filter(F.col("last") >= min(wanted)).filter(F.col("first") <= max(wanted)).select("path", "before").collect()  # a row for each file in reach
    if not files:
        return empty
    before = spark.createDataFrame([(r["path"].rpartition("/")[2], r["before"]) for r in files], "_file string, _before long")
    found = spark.read.schema(empty.schema).parquet(*[r["path"] for r in files]).filter(F.col("doc_id").isin(wanted)).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return found.join(F.broadcast(before), "_file").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids")


def _crc(b: pa.RecordBatch) -> pa.RecordBatch:
    ids = b.column("ids")
    flat, at = np.asarray(ids.flatten(), np.int32).astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths())])
    crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's columns, read back from a store in the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, tokenizer_path, path)
    return read(spark, path, _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
