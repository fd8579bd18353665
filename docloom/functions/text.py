"""Text expressions: built-in column functions, no Python rows.

Null input gives null unless said otherwise; lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of sentences after which text is split, in regular expression form.
SENTENCE_END = "[。！？.!?；;]"

#: Longest values that are kept (fixed values).
CAPS = {"name": 160, "entity_type": 40, "description": 600, "predicate": 100, "relation_description": 800, "title": 80, "summary": 2000, "error": 1000}


def trim_space(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_space(c: Column) -> Column:
    """CRLF and CR to LF, then runs of spaces and tabs to one space."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")


def paragraphs(c: Column) -> Column:
    """Non-blank paragraphs: cut at two or more LF, or at one LF after an ideographic full stop."""
    parts = F.split(c, r"\n{2,}|(?<=。)\n")
    return F.filter(F.transform(parts, trim_space), lambda x: F.length(x) > 0)


def sentences(c: Column) -> Column:
    """Non-blank sentences: cut after an end mark, white space swallowed."""
    parts = F.split(c, rf"(?U)(?<={SENTENCE_END})\s*")
    return F.filter(F.transform(parts, trim_space), lambda x: F.length(x) > 0)


def overlap_tail(c: Column, overlap: int) -> Column:
    """The last ``overlap`` characters, from after their first LF, ideographic full stop or space."""
    if overlap <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    tail = F.right(c, F.lit(overlap))
    marks = [F.when(F.instr(tail, m) > 0, F.instr(tail, m)) for m in ("\n", "。", " ")]
    first = F.least(*marks)
    return F.when(first.isNull(), tail).otherwise(F.substring(tail, first + 1, F.length(tail)))


def hard_slices(c: Column, size: int) -> Column:
    """Slices of ``size`` characters; the last may be shorter, an empty text has none."""
    n = F.ceil(F.length(c) / F.lit(size)).cast("int")
    slices = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    return F.when(F.length(c) > 0, slices).when(c.isNotNull(), F.array().cast("array<string>"))


def windows(c: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` characters every ``size - overlap``."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1 - overlap), F.lit(step))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size))))


def token_count(c: Column) -> Column:
    """A third of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3)).cast("long")


def strip_fence(c: Column) -> Column:
    """Without one enclosing Markdown fence."""
    t = trim_space(c)
    inner = F.regexp_extract(t, r"(?s)^```[A-Za-z0-9_-]*[ \t]*\n(.*)\n?```$", 1)
    return F.when(t.rlike(r"(?s)^```[A-Za-z0-9_-]*[ \t]*\n.*```$"), trim_space(inner)).otherwise(t)


def safe_filename(c: Column) -> Column:
    """The base name with runs of unusual characters as ``_``, 180 characters at most."""
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    clean = F.substring(F.regexp_replace(base, r"[^0-9A-Za-z_.()\-\x{4e00}-\x{9fff}]+", "_"), 1, 180)
    return F.when(F.length(F.coalesce(clean, F.lit(""))) == 0, F.lit("document")).otherwise(clean)


def normalize_name(c: Column) -> Column:
    """Trimmed, white space as one space, lower case."""
    return F.lower(trim_space(F.regexp_replace(c, r"(?U)\s+", " ")))


def clamp_weight(c: Column) -> Column:
    """Weights in [0.1, 10]; null counts as 1, NaN as 0.1."""
    return F.when(c.isNull(), F.lit(1.0)).when(F.isnan(c), F.lit(0.1)).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.1), c)))


def metadata(c: Column) -> Column:
    """JSON text as map<string,string>; null, broken or other JSON as an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), "map<string,string>"), empty)


def json_object(c: Column) -> Column:
    """The object in a model's answer as JSON text: without a fence, else the widest {...}; null if none."""
    bare = strip_fence(c)
    wide = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    pick = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare).when(F.length(wide) > 0, wide)
    return F.when(F.try_parse_json(pick).isNotNull(), pick)


def markdown_cell(c: Column) -> Column:
    """A table cell: pipes escaped, CR as space, LF as <br>, null as nothing."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))


def progress_percent(done: Column, total: Column) -> Column:
    """Rounded per cent, 100 at most; 0 where the total is 0 or null."""
    return F.when(total > 0, F.least(F.lit(100.0), F.round(100.0 * done / total))).otherwise(0.0).cast("long")
