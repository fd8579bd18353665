"""Problem 4: items larger than a limit, cut at natural boundaries with an overlap.

Byte-range processing: an item of any size is a row per range of its text (or of its file,
``file_ranges``), so no worker holds a whole item.

1. every range is normalised by itself; one character before it is halo enough for that;
2. the boundary table has each range's length and the end of its text; windows over the
   ranges of an item give each range its offset (prefix sums) and the tail of the range
   before it;
3. every range cuts its text into pieces from the last natural boundary of the range before
   it to its own last one. Both neighbours find that boundary in the same tail, so they
   agree without talking. Piece numbers come from prefix sums of the ranges' piece counts.
"""

from __future__ import annotations

import bisect
import contextlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.tables import Stage, shared_dir

LIMIT, OVERLAP = 900, 160
#: Code points of a text range and bytes of a file range; any size gives pieces within the limit.
TEXT_RANGE, FILE_RANGE = 65_536, 4 << 20
#: File ranges that a task reads one after the other.
TASK_RANGES = 32

_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[。！？；]+[」』”’）)]*\s*|[.!?;]+[\"'”’)]*(?:\s+|$)|\n")
_WORD = re.compile(r"\s+|(?<=[，、：])")


def text_ranges(items: DataFrame, text: str, keep: list[str], size: int = TEXT_RANGE) -> DataFrame:
    """``keep``, range, ranges, before (the character before the range), body. Null texts are dropped.

    Only texts over ``size`` are sliced, in one pass over each; all others are their own range
    and aren't handed to Python.
    """

    @F.pandas_udf("array<struct<before:string,body:string>>")
    def slices(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"before": t[max(0, i - 1) : i], "body": t[i : i + size]} for i in range(0, len(t), size)] for t in texts])

    rows = items.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_t"))
    large = F.length("_t") > size
    whole = F.array(F.struct(F.lit("").alias("before"), F.col("_t").alias("body")))
    rows = rows.withColumn("_cut", F.coalesce(slices(F.when(large, F.col("_t"))), whole)).drop("_t")
    rows = rows.select(*keep, F.size("_cut").alias("ranges"), F.posexplode("_cut").alias("range", "_r"))
    return rows.select(*keep, "range", "ranges", "_r.before", "_r.body")


def file_ranges(spark: SparkSession, path: str, size: int = FILE_RANGE) -> DataFrame:
    """path, range, ranges, before, body of UTF-8 files; each task reads its own bytes only.

    A character belongs to the range in which its first byte lies; broken bytes become U+FFFD.
    Listing the files reads no content. ``path`` must be on storage that all executors see.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / F.lit(size)).cast("int"))
    rows = files.withColumn("ranges", n).withColumn("range", F.explode(F.sequence(F.lit(0), n - 1)))
    # rows of names and numbers look tiny, so the number of tasks is stated: adaptive planning would make one of them
    tasks = files.agg(F.ceil(F.sum(n) / TASK_RANGES).cast("int")).first()[0] or 1
    rows = rows.repartition(tasks, "path", "range")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.itertuples(index=False):
                where = re.sub(r"^file:/+", "/", r.path)
                system, name = (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(where)
                begin = r.range * size
                with system.open_input_file(name) as f:
                    lead = min(begin, 8)
                    f.seek(begin - lead)
                    raw = f.read(lead + size + 4)
                own = _owned(raw, lead, min(len(raw), lead + size))
                before = raw[: own[0]].decode("utf-8", "replace")[-1:]
                body = raw[own[0] : own[1]].decode("utf-8", "replace")
                yield pd.DataFrame({"path": [r.path], "range": [r.range], "ranges": [r.ranges], "before": [before], "body": [body]})

    return rows.select("path", "range", "ranges").mapInPandas(run, "path string, range int, ranges int, before string, body string")


def _owned(raw: bytes, begin: int, end: int) -> tuple[int, int]:
    """``begin`` and ``end`` moved on past continuation bytes (three at most)."""
    out = []
    for at in (begin, end):
        for _ in range(3):
            if 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
        out.append(at)
    return out[0], out[1]


def normalised(before, body):
    """Line ends to LF and runs of spaces and tabs to one space, in the context of one character."""
    whole = F.regexp_replace(F.regexp_replace(F.concat(before, body), r"\r\n?", "\n"), "[ \t]+", " ")
    return F.substring(whole, F.when(before == "", 1).otherwise(2), F.length(whole))


def measured(ranges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Ranges with their normalised text, without those that are a whole item within ``limit``.

    That is decided where the text is read; only larger items and cases go on.
    """
    rows = ranges.withColumn("text", normalised(F.col("before"), F.col("body"))).drop("before", "body")
    trimmed = F.length(F.regexp_replace("text", "^[ \n]+|[ \n]+$", ""))
    return rows.where((F.col("ranges") > 1) | (trimmed > limit))


def boundaries(rows: DataFrame, key: str, limit: int = LIMIT, tail: int = 0) -> DataFrame:
    """The boundary table of items over ``limit``: key, range, skip, size, offset, halo, last.

    skip and size say which part of the range's text lies in the trimmed item, offset where
    in the item; halo is the end of the text of the range before, last marks the item's end.
    Windows over an item see lengths and ends of texts only, never the texts.
    """
    text = F.col("text")
    small = rows.select(
        key, "range", F.length(text).alias("_n"), (F.length(text) - F.length(F.regexp_replace(text, "^[ \n]+", ""))).alias("_lead"),
        (F.length(text) - F.length(F.regexp_replace(text, "[ \n]+$", ""))).alias("_trail"), F.right(text, F.lit(2 * tail)).alias("_end"),
    )
    item = Window.partitionBy(key)
    forward, back = item.orderBy("range"), item.orderBy(F.desc("range"))
    blank = F.col("_lead") == F.col("_n")
    before = F.coalesce(F.min(blank).over(forward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    after = F.coalesce(F.min(blank).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    small = small.withColumn("_before", before).withColumn("_after", after)
    small = small.withColumn("skip", F.when(F.col("_before"), F.col("_lead")).otherwise(0))
    drop = F.when(F.col("_after") & ~(F.col("_before") & blank), F.col("_trail")).otherwise(0)
    small = small.withColumn("_drop", drop).withColumn("size", F.greatest(F.lit(0), F.col("_n") - F.col("skip") - F.col("_drop")))
    small = small.withColumn("_total", F.sum("size").over(item)).where((F.col("_total") > limit) & (F.col("size") > 0))
    # the end of the text that counts: of a cut range less than what was carried
    small = small.withColumn("_end", F.expr("right(substring(_end, 1, length(_end) - _drop), least(size, %d))" % tail))
    offset = F.coalesce(F.sum("size").over(forward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = small.withColumn("offset", offset).withColumn("halo", F.coalesce(F.lag("_end").over(forward), F.lit(""))).withColumn("last", F.lead("range").over(forward).isNull())
    return small.select(key, "range", "skip", "size", "offset", "halo", "last")


def split(ranges: DataFrame, key: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = TEXT_RANGE) -> DataFrame:
    """``keep``, piece (from 0 in each item), begin, end (offsets in the normalised item), content.

    Pieces have at most ``limit`` code points, end at a paragraph, sentence or word end where
    there is one in the last two thirds of the piece (else exactly at the limit), and repeat up
    to ``overlap`` code points of the piece before, from a sentence or word begin where there is
    one. Items within the limit give no rows; null texts neither. ``key`` must tell items
    apart; rows with an equal key and range number are not supported. ``size`` is that of the ranges.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    spark = ranges.sparkSession
    stage = Stage(spark, "pieces")

    @F.pandas_udf("array<struct<begin:bigint,end:bigint,content:string>>")
    def cut(text: pd.Series, halo: pd.Series, offset: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([cut_range(t, h, o, z, limit, overlap) for t, h, o, z in zip(text, halo, offset, last)])

    with _small_batches(spark, size):
        texts = stage.put(measured(ranges, limit))
        rows = texts.join(boundaries(texts, key, limit, limit + overlap), [key, "range"]).withColumn("text", F.expr("substring(text, skip + 1, size)"))
        pieces = stage.put(rows.select(*keep, "range", F.posexplode(cut("text", "halo", "offset", "last")).alias("_i", "_p")).select(*keep, "range", "_i", "_p.begin", "_p.end", "_p.content"))
    stage.drop(texts)
    order = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy(key, "range").agg(F.count(F.lit(1)).alias("_k"))
    done = sizes.select(key, "range", F.coalesce(F.sum("_k").over(order), F.lit(0)).alias("_done"))
    rows = pieces.join(done, [key, "range"])
    return rows.select(*keep, (F.col("_done") + F.col("_i")).alias("piece"), "begin", "end", "content")


@contextlib.contextmanager
def _small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """While tables are written: batches of about 32 MiB for rows of ``size`` characters, between Spark's reader and Python too."""
    rows = str(max(16, min(2000, (1 << 25) // size)))
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    held = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, rows)
        yield
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)


class _Cuts:
    """The natural boundaries of a text, best kind first."""

    def __init__(self, text: str):
        ends = [m.end() for m in _PARAGRAPH.finditer(text)], [m.end() for m in _SENTENCE.finditer(text)], [m.end() for m in _WORD.finditer(text)]
        self.kinds = ends

    def last(self, low: int, high: int, floor: int) -> int:
        """The best cut in (low, high], first among those after ``floor``; ``high`` if there is none."""
        for least in (max(low, floor), low):
            for ends in self.kinds:
                i = bisect.bisect_right(ends, high) - 1
                if i >= 0 and ends[i] > least:
                    return ends[i]
        return high

    def first(self, low: int, high: int) -> int:
        """The first sentence begin in [low, high), else word begin, else ``low``."""
        for ends in self.kinds[1:]:
            i = bisect.bisect_left(ends, low)
            if i < len(ends) and ends[i] < high:
                return ends[i]
        return low


def _seam(tail: str, limit: int) -> int:
    """Where the piece after ``tail`` begins without overlap, in code points from its end."""
    tail = tail[-limit:]
    return len(tail) - _Cuts(tail).last(0, len(tail), len(tail) // 3)


def cut_range(text: str, halo: str, offset: int, last: bool, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin, end, content) of the pieces from the seam in ``halo`` to the seam in ``text``."""
    whole, base = halo + text, offset - len(halo)
    done = len(halo) - (_seam(halo, limit) if halo else 0)
    stop = len(whole) if last else len(whole) - _seam(text[-(limit + overlap) :], limit)
    cuts = _Cuts(whole)
    out: list[tuple[int, int, str]] = []
    begin = cuts.first(max(0, done - overlap), done) if done else 0
    while done < stop:
        end = stop if stop - begin <= limit else cuts.last(done, begin + limit, begin + limit // 3)
        b, e = begin, end
        while b < e and whole[b] in " \n":
            b += 1
        while e > b and whole[e - 1] in " \n":
            e -= 1
        if e > b:
            out.append((base + b, base + e, whole[b:e]))
        begin, done = cuts.first(max(0, end - overlap), end), end
    return out


def chunk_ranges(chunks: DataFrame) -> DataFrame:
    return text_ranges(chunks.withColumnRenamed("id", "chunk_id"), "content", ["chunk_id", "chunk_index", "page_number"])


def chunk_pieces(chunks: DataFrame) -> DataFrame:
    """p4_pieces: the pieces of all chunks over the limit, with chunk_index and page_number."""
    return split(chunk_ranges(chunks), "chunk_id", ["chunk_id", "chunk_index", "page_number"])


def long_chunks(chunks: DataFrame) -> DataFrame:
    """p4_found: chunk_id of the chunks that `split` cuts."""
    rows = chunk_ranges(chunks).select("chunk_id", "range", "ranges", "before", "body")
    return split(rows, "chunk_id", ["chunk_id"]).select("chunk_id").distinct()


def document_pieces(documents: DataFrame, size: int = 4096) -> DataFrame:
    """p4_document_pieces: doc_id, piece, begin, end, content of every text over the limit, in ranges so small that most texts have several."""
    return split(text_ranges(documents, "text", ["doc_id"], size), "doc_id", ["doc_id"], size=size)


def file_pieces(documents: DataFrame, size: int = 1 << 16) -> DataFrame:
    """p4_file_pieces: source, file, piece, begin, end, content of text files that hold the documents of a source.

    The files are written to the shared folder first, a null source as ``__null__``; then each
    range of ``size`` bytes is read by its own task.
    """
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    rows = documents.where("text is not null").select(F.coalesce("source", F.lit("__null__")).alias("source"), F.col("text").alias("value"))
    rows.write.partitionBy("source").text(path)
    ranges = file_ranges(spark, f"{path}/source=*/*.txt", size)
    rows = split(ranges, "path", ["path"], size=size)
    source, file = F.regexp_extract("path", "source=([^/]*)/", 1), F.regexp_extract("path", "part-([0-9]+)", 1).cast("int")
    return rows.select(F.url_decode(source).alias("source"), file.alias("file"), "piece", "begin", "end", "content")
