"""Splitting documents into overlapping chunks at paragraphs and sentences.

Packing depends on what was packed before, so it is a fold over one text: a small function
per row inside ``mapInPandas``; nothing is shuffled and no text leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"\n{2,}|(?<=。)\n")
_SENTENCE = re.compile(r"(?<=[。！？.!?；;])\s*")
_SCHEMA = "chunk_index long, content string, token_count long"


def _flat(text: str, size: int) -> tuple[str, list[tuple[int, int]]]:
    """The text as its units, a blank line between them, and where each unit begins and ends.

    A unit is a run of a paragraph's sentences within ``size``, or a slice of a longer sentence.
    """
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0  # end of the last unit

    def add(piece: str, gap: str) -> None:
        nonlocal at
        begin = at + len(gap) if parts else 0
        parts.extend([gap, piece] if parts else [piece])
        at = begin + len(piece)
        if gap == " ":
            spans[-1] = spans[-1][0], at
        else:
            spans.append((begin, at))

    for paragraph in _PARAGRAPH.split(text):
        room = -1  # what the open unit can still take; none is open at a paragraph's begin
        for sentence in map(str.strip, _SENTENCE.split(paragraph)):
            if not sentence:
                continue
            if len(sentence) < room:
                add(sentence, " ")
                room -= len(sentence) + 1
            else:
                for i in range(0, len(sentence), size):
                    piece = sentence[i : i + size]
                    if piece.strip():
                        add(piece.rstrip() if parts else piece, "\n\n")
                room = size - len(sentence)
    return "".join(parts), spans


def _ink(flat: str, at: int) -> int:
    while flat[at].isspace():
        at += 1
    return at


def _cuts(flat: str, spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each chunk: as many units as fit; the next one begins in the overlap, at a unit at the latest."""
    begin = end = None
    for b, e in spans:
        if begin is None:
            begin = b
        elif e - _ink(flat, begin) <= size:
            begin = _ink(flat, begin)
        else:
            yield begin, end
            lap = max(begin, end - overlap)
            marks = [m for m in (flat.find(x, lap, end) for x in "\n。 ") if m >= 0]
            begin = max(_ink(flat, min(marks) + 1 if marks else lap), e - size)
        end = e
    if end is not None:
        yield begin, end


def pack(text: str | None, size: int, overlap: int) -> list[str]:
    """The chunks of one section, each a slice of its units with blank lines between them.

    A new chunk begins with the overlap tail of the one before; if that makes it too long,
    its front is cut. Null and blank texts have no chunks.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    clean = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text or ""))
    flat, spans = _flat(clean, size)
    return [flat[b:e] for b, e in _cuts(flat, spans, size, overlap)]


def chunk(df: DataFrame, text: str, keep: list[str], size: int = 900, overlap: int = 160) -> DataFrame:
    """``keep``, chunk_index (from 0 per row), content, token_count."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    data = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + _SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [pack(t, size, overlap) for t in batch.pop("_text")]
            if not any(parts):
                continue
            out = batch.loc[batch.index.repeat([len(p) for p in parts])].reset_index(drop=True)
            out["chunk_index"] = [i for p in parts for i in range(len(p))]
            out["content"] = [c for p in parts for c in p]
            out["token_count"] = [max(1, len(c) // 3) for p in parts for c in p]
            yield out

    return data.mapInPandas(run, schema)


@F.udtf(returnType=_SCHEMA)
class ChunkText:
    """``LATERAL chunk_text(text, size, overlap)`` for SQL users."""

    def eval(self, text: str, size: int, overlap: int):
        for i, content in enumerate(pack(text, size, overlap)):
            yield i, content, max(1, len(content) // 3)


def register(spark) -> None:
    spark.udtf.register("chunk_text", ChunkText)
