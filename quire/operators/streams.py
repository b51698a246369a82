"""Server-sent events put together again from chunks that are cut anywhere."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltas(lines: Iterator[str]) -> Iterator[str]:
    """The contents of `data:` lines; lines that don't parse are passed over."""
    for line in lines:
        line = line.strip()
        if not line.startswith("data:") or (payload := line[5:].strip()) == "[DONE]":
            continue
        try:
            content = json.loads(payload)["choices"][0]["delta"].get("content")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError):
            continue
        if content:
            yield content


#: Characters of an answer after which another row of it begins.
PIECE = 1 << 20


def answers(chunks: DataFrame, size: int = PIECE) -> DataFrame:
    """chunks (conv_id, seq, chunk BINARY) to conv_id, piece, text. Rows stream in order; a part of a line and a piece of text are held, however long an answer is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rest, parts, length, piece = None, b"", [], 0, 0
        for frame in frames:
            done = []
            for conv, chunk in zip(frame["conv_id"], frame["chunk"], strict=True):
                if conv != at:
                    if at is not None and (parts or not piece):
                        done.append((at, piece, "".join(parts)))
                    at, rest, parts, length, piece = conv, b"", [], 0, 0
                *whole, rest = (rest + bytes(chunk)).split(b"\n")
                new = list(deltas(x.decode("utf-8", "replace") for x in whole))
                parts += new
                length += sum(map(len, new))
                if length >= size:
                    done.append((at, piece, "".join(parts)))
                    parts, length, piece = [], 0, piece + 1
            yield pd.DataFrame(done, columns=["conv_id", "piece", "text"])
        if at is not None and (parts or not piece):
            yield pd.DataFrame([(at, piece, "".join(parts))], columns=["conv_id", "piece", "text"])

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "chunk").mapInPandas(run, "conv_id long, piece int, text string")


def reassembled(chunks: DataFrame) -> DataFrame:
    """chunks (conv_id, seq, chunk BINARY) to conv_id, text: a row holds an answer, so use answers() where one may not fit."""
    pieces = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return answers(chunks).groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def streamed(chunks: DataFrame) -> DataFrame:
    """A stream of chunks (conv_id, seq, chunk) to conv_id, seq, text: what each micro-batch adds to an answer, under its last chunk's seq.

    The state of a conversation is its unfinished line. Its chunks must come in order from batch to batch.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values("seq")
        *whole, rest = (bytes(state.get[0] if state.exists else b"") + b"".join(map(bytes, rows["chunk"]))).split(b"\n")
        state.update((rest,))
        if text := "".join(deltas(x.decode("utf-8", "replace") for x in whole)):
            yield pd.DataFrame({"conv_id": [key[0]], "seq": [rows["seq"].iloc[-1]], "text": [text]})

    return chunks.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, seq int, text string", "rest binary", "append", "NoTimeout")


def chunked(texts: DataFrame, letters: int = 7, size: int = 50) -> DataFrame:
    """Texts (conv_id, text) as a model would send them, cut every `size` bytes: for tests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, text in zip(frame["conv_id"], frame["text"], strict=True):
                lines = [json.dumps({"choices": [{"delta": {"content": text[i : i + letters]}}]}, ensure_ascii=False) for i in range(0, len(text), letters)]
                raw = "".join(f"data: {x}\n\n" for x in [*lines, "[DONE]"]).encode()
                out += [(conv, i, raw[i * size : (i + 1) * size]) for i in range(-(-len(raw) // size))]
            yield pd.DataFrame(out, columns=["conv_id", "seq", "chunk"])

    return texts.select("conv_id", "text").mapInPandas(run, "conv_id long, seq int, chunk binary")
