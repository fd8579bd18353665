"""Problem 5: defects of text from scanned pages and its repair into paragraphs.

1. The corpus vocabulary counts words, hyphen compounds and, for Chinese, characters with
   their two neighbours, over all chunks.
2. A word (or Chinese character in its place) is misread if undoing one confusion of scanned
   print gives one that is much more frequent. This is a join of the vocabulary with itself.
3. One more pass over all chunks finds broken line ends, tokens outside the frequent
   vocabulary and the lines at page edges; joins with the tables above decide.
4. A line at a page's top or foot is a running one if it comes again on other pages of its
   document. Lines are compared by the edit distance of skeletons that all confusions leave as
   they are; page numbers are known by form and by their sequence.
5. Words cut at the end of a page are joined with the begin of the next one by the same counts.

Only the frequent vocabulary (at most COMMON entries) goes to the tasks as a whole; it saves
look-ups and changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import Stage

#: Most frequent entries that tasks hold to pass over ordinary tokens; a bound on memory only,
#: as every other token is looked up by a join.
COMMON = 100_000
#: A misread form is this many times rarer than the right one, which has at least LEAST cases.
RATIO, LEAST = 10, 8
HAN_RATIO = 20
#: The same for a Chinese character with one neighbour only, which says less.
PAIR_RATIO, PAIR_LEAST = 20, 40
#: Outside of scanned pages a misread form is this many times rarer still.
PLAIN = 10
_OPEN = "\x01"

# fixed values: right form and form misread in scanned print
LATIN_PAIRS = [
    ("e", "c"), ("a", "@"), ("t", "f"), ("i", "l"), ("n", "ri"), ("s", "5"), ("o", "0"), ("l", "1"), ("u", "ii"), ("h", "b"), ("m", "rn"), ("g", "9"),
    ("w", "vv"), ("li", "h"), ("b", "8"), ("fi", "ﬁ"), ("ü", "ii"), ("rn", "m"), ("cl", "d"), ("d", "cl"), ("l", "i"), ("i", "1"), ("g", "q"), ("c", "e"),
]
# fixed values: right and misread Chinese characters of like shape
HAN_PAIRS = (
    "日曰 表裱 由田 测侧 备奋 已巳 上土 门们 记纪 批比 人入 据剧 未末 工丅 千干 干千 录绿 土士 第策 大太 入人 期朗 更吏 间问 量重 目日 动册 准淮 料科 木本 手毛 因囚 力刀 "
    "己已 末未 士土 太大 田由 问间 本木 刀力 比批 重量 科料 毛手 王玉 天夫 白自 自白 贝见 往住 住往 待侍 折拆 拔拨 侯候 戊戍 乌鸟 今令 名各 晴睛 渴喝 辨辩 遣遗 微徽 洒酒 兔免 免兔 己巳 巳已 口囗 二工 八入"
).split()

_SIGNS = str.maketrans({"@": "a", "0": "o", "1": "l", "5": "s", "9": "g", "8": "b"})
_L = "A-Za-zÀ-ÖØ-öø-ÿﬁﬂ"
_TOKEN = re.compile(rf"[{_L}@0-9]*[{_L}@][{_L}@0-9]*(?:-[{_L}@][{_L}@0-9]*)*")
_HYPHEN = re.compile(rf"([{_L}@0-9]+)([-¬‐­])[ \t​]*\r?\n[ \t]*([{_L}@0-9]+)")
_MARKS = "-¬‐­"
_SENTENCE_END = re.compile(r"[.。!！?？:：;；][\"'”’）)]*$")
_BLANK = [9, 10, 11, 12, 13, 32, 0x200B, 0x3000]
_READ_AS = {p[1]: p[0] for p in reversed(HAN_PAIRS)}
_HAN_MIDDLE = np.array(sorted({ord(c) for p in HAN_PAIRS for c in p}), np.uint32)


def words(text: str) -> Iterator[str]:
    """Lower-case tokens with letters, hyphen compounds also by their parts; no broken line ends."""
    if any(m in text for m in _MARKS):
        text = _HYPHEN.sub(" ", text)
    for token in _TOKEN.findall(text.lower()):
        if len(token) > 2:
            yield token
            if "-" in token:
                yield from (part for part in token.split("-") if len(part) > 2)


def han_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of each confusable character with both neighbours and with either one.

    White space is left out; _OPEN stands for the neighbour that is not looked at.
    """
    joined = "\0".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes[~np.isin(codes, _BLANK)]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = np.flatnonzero((codes[1:-1] >= 0x4E00) & np.isin(codes[1:-1], _HAN_MIDDLE)) + 1
    c = codes.astype(np.int64)
    left, own, right = c[middle - 1] << 42, c[middle] << 21, c[middle + 1]
    gap = np.int64(ord(_OPEN))
    keys = np.concatenate([left | own | right, left | own | gap, gap << 42 | own | right])
    return keys, np.tile(np.searchsorted(np.flatnonzero(codes == 0), middle), 3)


def _gram(key: int) -> str:
    return chr(key >> 42) + chr(key >> 21 & 0x1FFFFF) + chr(key & 0x1FFFFF)


def vocabulary(chunks: DataFrame, content: str = "content") -> DataFrame:
    """gram, n over all chunks; every task counts its own first."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for t in texts:
                held.update(words(t))
            keys, n = np.unique(han_grams(texts)[0], return_counts=True)
            held.update(dict(zip(map(_gram, keys.tolist()), n.tolist())))
            if len(held) > 400_000:
                yield _counts(held)
                held = Counter()
        yield _counts(held)

    counted = chunks.select(content).mapInArrow(run, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])


def candidates(gram: str) -> list[tuple[str, int, int]]:
    """(right form, ratio and least count that it needs) for each confusion undone in ``gram``."""
    if len(gram) == 3 and gram[1] in _READ_AS and gram[1] >= "一":
        out = [gram[0] + p[0] + gram[2] for p in HAN_PAIRS if p[1] == gram[1]]
        return [(g, PAIR_RATIO, PAIR_LEAST) if _OPEN in g else (g, HAN_RATIO, LEAST) for g in out]
    out = {}
    signs = gram.translate(_SIGNS)
    if signs != gram:
        if sum(c.isalpha() for c in gram) < 3:
            return []
        out[signs] = (2, 3)
        gram = signs
    if len(gram) >= 4:
        for right, read in LATIN_PAIRS:
            at = gram.find(read)
            while at >= 0:
                out.setdefault(gram[:at] + right + gram[at + len(read) :], (RATIO, LEAST))
                at = gram.find(read, at + 1)
    return [(g, *need) for g, need in out.items()]


def misreadings(counts: DataFrame) -> DataFrame:
    """gram, right, plain: vocabulary entries that are a misreading, the most frequent form they stand for, and whether that is so likely that nothing else must speak for a scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(g, n, *c) for g, n in zip(batch["gram"], batch["n"]) for c in candidates(g)]
            if rows:
                yield pd.DataFrame(rows, columns=["gram", "n", "right", "ratio", "least"])

    tried = counts.mapInPandas(run, "gram string, n long, right string, ratio int, least int")
    known = counts.select(F.col("gram").alias("right"), F.col("n").alias("m"))
    hit = tried.join(known, "right").where("m >= least and m >= ratio * n")
    best = hit.withColumn("plain", (F.col("m") >= PLAIN * F.col("ratio") * F.col("n")) & ~F.contains("gram", F.lit(_OPEN)))
    best = best.groupBy("gram").agg(F.max_by(F.struct("right", "plain"), F.struct("m", "right")).alias("b"))
    return best.select("gram", "b.right", "b.plain")


# --- page edges -------------------------------------------------------------------------

_D = r"[0-9lIOoSB]{1,4}"
_ROMAN = re.compile(r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
# fixed values: printed forms of page numbers; letters may be misread
_FORMS = [
    re.compile(p, re.I)
    for p in (
        rf"^p[a@]?[g9q]?[ec]?\.?\s*({_D})(?:\s*(?:[o0]f|/)\s*{_D})?$", rf"^[s5][ec][il1][tf][ec]\s*({_D})(?:\s*v[o0](?:n|ri)\s*{_D})?$", rf"^p[.,]\s*({_D})$", rf"^s[.,]\s*({_D})$",
        rf"^({_D})\s*[|]\s*(?:p[a@][g9q][ec]|[s5][ec][il1][tf][ec])$", r"^[-–—·•~*]\s*(\d{1,4})\s*[-–—·•~*]$", r"^[\[(（【](\d{1,4})[\])）】]$",
        r"^[第策]\s*(\d{1,4})\s*[页頁](?:\s*[/,，共]*\s*共?\s*\d{1,4}\s*[页頁])?$", r"^(\d{1,4})\s*[/／]\s*\d{1,4}$", r"^(\d{1,4})\s*[页頁]$",
    )
]
_SIDE = re.compile(r"^(?:(\d{1,4})(?:\s{2,}|\t)(\S.*)|(.*\S)(?:\s{2,}|\t)(\d{1,4}))$")


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, whether the form alone shows that it is a page number) of a line, or None."""
    line = line.strip()
    if not line or len(line) > 24:
        return None
    for form in _FORMS:
        if m := form.match(line):
            digits = m[1].translate(str.maketrans("lIOoSB", "110058"))
            return int(digits), True
    if line.isdecimal() and len(line) <= 4:
        return int(line), False
    if _ROMAN.match(line) and line.islower():
        total, last = 0, 0
        for v in (dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in reversed(line)):
            total, last = (total - v, last) if v < last else (total + v, v)
        return total, False
    return None


def _one_form(pairs: list[str]) -> dict[str, str]:
    """Each character of the pairs -> the smallest one that it may be taken for, by any chain of pairs."""
    form: dict[str, str] = {}

    def find(c: str) -> str:
        while form.setdefault(c, c) != c:
            c = form[c]
        return c

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        form[high] = low
    return {c: find(c) for c in form}


_SKELETON = str.maketrans(
    {"c": "e", "@": "a", "f": "t", "l": "i", "1": "i", "n": "ri", "5": "s", "0": "o", "u": "ii", "ü": "ii", "b": "ii", "h": "ii", "8": "ii", "m": "rri", "9": "g", "q": "g", "w": "vv", "d": "ei", "ﬁ": "ti"}
    | _one_form(HAN_PAIRS)
)


def skeleton(line: str) -> str:
    """A form that letter case, spaces and all confusions leave as it is."""
    return "".join(line.lower().split()).translate(_SKELETON)


def edges(content: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(line or '', number or -1, flag, whether text is next to it, foot) of a page's edge lines.

    The flag says of a number that its form alone shows it and of a line that it was ended
    early. Up to three lines at the top and three at the foot count.
    """
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    width = max((len(x.strip()) for x in lines), default=0)
    out: list[tuple[str, int, bool, bool, bool]] = []
    for i in at[:3]:
        line = lines[i].strip()
        number = page_number(line)
        if number:
            out.append(("", number[0], number[1], False, False))
            continue
        head, n = _running(line)
        if not head:
            break
        below = lines[i + 1].split() if i + 1 < len(lines) else []
        # a full line of running text leaves no room for the next word; a heading does
        room = bool(below) and len(line) + 1 + (len(below[0]) if below[0].isascii() else 1) <= width
        out.append((head, n, room, bool(below), False))
        if not room:
            break
    running = True
    for up, i in enumerate(reversed(at[3:][-3:])):
        line = lines[i].strip()
        number = page_number(line)
        if number and (running or up < 2):
            out.append(("", number[0], number[1], False, True))
            continue
        head, n = _running(line)
        above = lines[i - 1].strip()
        running = running and bool(head) and not (len(line) + 8 > width and above)
        if not running:
            continue
        # the line above it is full, ends a sentence or is blank
        room = not above or bool(_SENTENCE_END.search(above)) or len(above) + 12 > width
        out.append((head, n, room, True, True))
    return out


def _running(line: str) -> tuple[str, int]:
    """(text, page number beside it or -1) of a line that may be a running one, ('', -1) of others."""
    if len(line) > 110 or _SENTENCE_END.search(line) or line.endswith((",", "，", "、")):
        return "", -1
    head, n = line, -1
    if m := _SIDE.match(line):
        head, n = (m[2], int(m[1])) if m[1] else (m[3], int(m[4]))
    return (head, n) if any(c.isalpha() for c in head) else ("", -1)


def wrapped(content: str) -> bool:
    """Whether the text is broken into lines inside its sentences, as on a scanned page."""
    lines = content.replace("\r\n", "\n").split("\n")
    return any(len(a.strip()) > (18 if a.isascii() else 8) and b.strip() and not _SENTENCE_END.search(a.rstrip()) for a, b in zip(lines, lines[1:]))


_SEEN = "chunk_id string, value string, other string, number long, sure boolean, foot boolean, kind string"


def seen(chunks: DataFrame, common: list[str]) -> DataFrame:
    """What each chunk shows: rows of kind gram (not in ``common``), hyphen (sure, or to be decided), edge, page (broken into lines inside sentences)."""
    data = chunks.select("id", "content").where("content is not null")

    def run(batches):
        grams = [g for g in common if len(g) == 3 and g[1] >= "一"]
        latin = {*common}.difference(grams)
        han = np.array(sorted((ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in grams), np.int64)
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, t in zip(ids, texts):
                if "\n" in t or "\r" in t:
                    for head, n, sure, beside, foot in edges(t):
                        rows.append((i, head, skeleton(head) if beside else None, n, sure, foot, "edge"))
                    if wrapped(t):
                        rows.append((i, None, None, None, True, False, "page"))
                loose = set()
                for m in _HYPHEN.finditer(t) if any(x in t for x in _MARKS) else ():
                    a, b = m[1].lower(), m[3].lower()
                    loose.add(a + b)
                    if m[2] != "-":
                        rows.append((i, a + b, None, None, True, False, "hyphen"))
                    elif not m[3][0].isupper() and not (a[-1].isdigit() or b[0].isdigit()):
                        rows.append((i, a + b, f"{a}-{b}", None, False, False, "hyphen"))
                for w in {*words(t), *loose} - latin:
                    rows.append((i, w, None, None, True, False, "gram"))
            keys, which = han_grams(texts)
            if len(keys):
                rare = ~np.isin(keys, han)
                for key, k in set(zip(keys[rare].tolist(), which[rare].tolist())):
                    rows.append((ids[k], _gram(key), None, None, True, False, "gram"))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.string()] * 3 + [pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["chunk_id", "value", "other", "number", "sure", "foot", "kind"])

    return data.mapInArrow(run, _SEEN)


def ending(skeleton_col, head_col):
    """The last word of a header, for Chinese its last two characters."""
    han = head_col.rlike("[㐀-鿿]$")
    return F.when(han, F.expr("right(skeleton, 2)")).otherwise(F.lower(F.regexp_extract(head_col, r"(\S+)$", 1)))


def repeated(heads: DataFrame) -> DataFrame:
    """document_id, foot, skeleton, pages: on how many of its document's pages a line stands, nearly equal ones with it.

    Lines of one document with the same first (or last) five characters are compared with the
    most frequent of them, so the work is linear; nearly equal is an edit distance of an eighth
    of the length, none for lines of three digits or more (rows of tables and logs). A line
    takes the better of its two counts.
    """
    place = ["document_id", "foot"]
    digits = F.length(F.regexp_replace("head", "[^0-9]", ""))
    once = heads.groupBy(*place, "skeleton").agg(F.countDistinct("chunk_id").alias("n"), F.max(digits).alias("digits"))
    sides = F.array(F.concat(F.lit("<"), F.left("skeleton", F.lit(5))), F.concat(F.lit(">"), F.right("skeleton", F.lit(5))))
    keyed = once.withColumn("key", F.explode(sides))
    chief = keyed.groupBy(*place, "key").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("chief"))
    near = keyed.join(chief, [*place, "key"]).where(F.levenshtein("skeleton", "chief") <= F.when(F.col("digits") > 2, 0).otherwise(F.floor(F.length("skeleton") / 8)))
    pages = near.groupBy(*place, "key").agg(F.sum("n").alias("pages"))
    return near.join(pages, [*place, "key"]).groupBy(*place, "skeleton").agg(F.max("pages").alias("pages"))


def page_lines(edge: DataFrame, page: DataFrame, chunks: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(chunks with a running line and the line, chunks with a page number) from the rows of kinds edge and page."""
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "page_number")
    pages = page.select("chunk_id", F.lit(True).alias("scan"))
    lines = stage.put(edge.join(place, "chunk_id").join(pages, "chunk_id", "left").withColumn("scan", F.coalesce("scan", F.lit(False))))

    heads = lines.where("other <> ''").select("chunk_id", "document_id", F.col("value").alias("head"), F.col("other").alias("skeleton"), "sure", "foot")
    heads = heads.withColumn("ending", ending(F.col("skeleton"), F.col("head"))).join(repeated(heads), ["document_id", "foot", "skeleton"], "left").fillna(1, ["pages"])
    heads = stage.put(heads)
    # endings of headers (say "handbook"): most lines at a page's top that end so come again
    docs = F.countDistinct(F.when(F.col("sure") & (F.col("pages") >= 2), F.col("document_id")))
    usual = heads.where("not foot").groupBy("ending").agg(docs.alias("_docs"), F.avg((F.col("sure") & (F.col("pages") >= 2)).cast("int")).alias("_part"))
    heads = heads.join(usual.where("_docs >= 3 and _part >= 0.5").select("ending", F.lit(True).alias("usual")), "ending", "left")
    formed = heads.where("usual and not foot").groupBy("document_id").agg(F.countDistinct("chunk_id").alias("formed"))
    scans = lines.groupBy("document_id").agg(F.countDistinct(F.when(F.col("scan"), F.col("chunk_id"))).alias("scans"), F.countDistinct("chunk_id").alias("edged"))
    heads = heads.join(formed, "document_id", "left").join(scans, "document_id", "left").withColumn("scans", F.when(F.col("scans") > 0, F.col("scans")).otherwise(F.col("edged")))
    top = "not foot and ((pages >= 2 and (usual or (sure and pages * 3 >= scans))) or (usual and (formed >= 2 or scans = 1)))"
    header = stage.put(heads.where(f"({top}) or (foot and sure and pages >= 2 and pages * 3 >= scans)").select("chunk_id", "head").distinct())

    numbers = lines.where("number >= 0").withColumn("gap", F.col("number") - F.coalesce("page_number", F.col("chunk_index")))
    numbers = numbers.withColumn("placed", F.col("page_number").isNotNull())
    runs = numbers.groupBy("document_id", "gap", "placed").agg(F.count(F.lit(1)).alias("_run"))
    numbers = numbers.join(runs, ["document_id", "gap", "placed"])
    in_head = F.col("value") != ""
    fits = (F.col("number") == F.col("page_number")) | (F.col("_run") >= 2) | F.col("page_number").isNull()
    beside = header.select("chunk_id", F.col("head").alias("value"), F.lit(True).alias("_beside"))
    numbers = numbers.join(beside, ["chunk_id", "value"], "left")
    numbers = numbers.where((~in_head & (F.col("sure") | F.col("scan") & fits)) | (in_head & F.col("_beside") & fits))
    return header, numbers.select("chunk_id").distinct()


def broken_words(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """value, other: of words cut at a hyphen (joined, as a compound) those that are no compound.

    Not a compound: the joined form is more frequent in the corpus (ten times so if the
    compound is a known one), or neither is known and not both halves are words.
    """
    pairs = pairs.select("value", "other").distinct().withColumn("_halves", F.split("other", "-"))
    rows = pairs.withColumn("_a", F.col("_halves")[0]).withColumn("_b", F.col("_halves")[1]).drop("_halves")
    for name, column in (("n_joined", "value"), ("n_compound", "other"), ("n_a", "_a"), ("n_b", "_b")):
        rows = rows.join(counts.select(F.col("gram").alias(column), F.col("n").alias(name)), column, "left").fillna(0, [name])
    known = "n_compound > 1 and n_joined > 10 * n_compound"
    new = "n_compound <= 1 and n_joined > n_compound"
    return rows.where(f"({known}) or ({new}) or (n_joined = 0 and n_compound = 0 and not (n_a > 1 and n_b > 1))").select("value", "other")


def frequent(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """gram of about ``most`` most frequent entries, all if there are fewer.

    The least count is found first, so no task hands its own best to the driver.
    """
    total = counts.count()
    if total <= most:
        return counts.select("gram")
    cut = counts.agg(F.percentile_approx("n", 1 - most / total, 100_000).alias("n")).first().n
    return counts.where(F.col("n") > cut).select("gram")


class Findings:
    """The tables of one run: misread tokens, broken words, running lines and page numbers by chunk."""

    def __init__(self, chunks: DataFrame):
        self.stage = stage = Stage(chunks.sparkSession, "scans")
        chunks = chunks.select("id", "document_id", "chunk_index", "page_number", "content")
        self.counts = stage.put(vocabulary(chunks))
        wrong = stage.put(misreadings(self.counts))
        common = [r.gram for r in frequent(self.counts.where("n > 1").join(wrong, "gram", "left_anti")).collect()]
        rows = stage.put(seen(chunks, common), by="kind")
        self.page = rows.where("kind = 'page'")
        # pages of scans: chunks broken into lines inside sentences, and the others of documents where most chunks are so
        place = chunks.select(F.col("id").alias("chunk_id"), "document_id").join(self.page.select("chunk_id", F.lit(True).alias("_page")), "chunk_id", "left")
        scans = place.groupBy("document_id").agg((F.count("_page") * 2 >= F.count(F.lit(1))).alias("_scan"))
        misread = rows.where("kind = 'gram'").select("chunk_id", F.col("value").alias("gram")).join(wrong, "gram").join(place, "chunk_id")
        scan = F.coalesce("_page", "_scan", F.lit(False))
        misread = stage.put(misread.join(scans, "document_id").select("chunk_id", "gram", "right", "plain", scan.alias("scan")).distinct())
        # elsewhere a form counts only if it isn't a word of texts that are no scans
        alien = misread.where("plain").groupBy("gram").agg(F.avg(F.col("scan").cast("int")).alias("_part"), F.count(F.lit(1)).alias("_n")).where("_part >= 0.5 or _n = 1").select("gram", F.lit(True).alias("_alien"))
        self.misread = misread.join(alien, "gram", "left").where("scan or _alien").select("chunk_id", "gram", "right")
        broken = rows.where("kind = 'hyphen'")
        unsure = broken.where("not sure").select("chunk_id", "value", "other")
        decided = unsure.join(broken_words(unsure, self.counts), ["value", "other"], "left_semi")
        self.broken = broken.where("sure").select("chunk_id", "value").unionByName(decided.select("chunk_id", "value"))
        self.headers, self.numbers = page_lines(rows.where("kind = 'edge'"), self.page, chunks, stage)

    def defects(self) -> DataFrame:
        parts = [(self.broken, "hyphen"), (self.misread, "char"), (self.headers, "header"), (self.numbers, "page_no")]
        out = None
        for table, name in parts:
            one = table.select("chunk_id", F.lit(name).alias("defect"))
            out = one if out is None else out.unionByName(one)
        return out.distinct()


def defects(chunks: DataFrame) -> DataFrame:
    """p5_found: chunk_id, defect (hyphen, char, header, page_no), one row each.

    Null and empty contents have no defects; chunks that share an id count as one.
    """
    return Findings(chunks).defects()


def _joined(text: str, width: int) -> str:
    """Lines joined to paragraphs: a blank line ends one, also a line that stops early after a full stop."""
    lines = text.split("\n")
    out = ""
    for line, below in zip(lines, [*lines[1:], ""]):
        out += line
        if not line or not below:
            out += "\n"
            continue
        han = bool(re.search("[㐀-鿿，。、；：！？）】]$", line)) or bool(re.match("[㐀-鿿，。、；：！？（【]", below))
        room = len(line) + 1 + (1 if han else len(below.split()[0])) < width - han
        if _SENTENCE_END.search(line) and room:
            out += "\n\n"
        else:
            out += "" if han else " "
    return out.strip("\n")


def repair(content: str, headers: list[str], numbered: bool, misread: dict[str, str], broken: set[str]) -> str:
    """The content without the named defects, as paragraphs."""
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    edge = {*filled[:3], *filled[-3:]}
    kept = []
    for i, line in enumerate(lines):
        bare = line.strip()
        if i in edge:
            if numbered and page_number(bare):
                continue
            m = _SIDE.match(bare)
            if bare in headers or m and (m[2] or m[3]) in headers:
                continue
        kept.append(line.strip(" \t　​"))
    text = "\n".join(kept).strip("\n")
    text = _HYPHEN.sub(lambda m: m[1] + m[3] if (m[1] + m[3]).lower() in broken else m[1] + m[2] + m[3], text)
    text = _joined(text, max(map(len, kept), default=0))
    for wrong, right in misread.items():
        if len(wrong) == 3 and wrong[1] >= "一":
            text = text.replace(wrong.strip(_OPEN), right.strip(_OPEN))
    if any(not ("一" <= w[1:2]) for w in misread):

        def fix(m: re.Match) -> str:
            right = misread.get(m[0].lower())
            if right is None:
                return m[0]
            return right.upper() if m[0].isupper() and len(m[0]) > 1 else right.capitalize() if m[0][0].isupper() else right

        text = _TOKEN.sub(fix, text)
    return re.sub(r"\n{3,}", "\n\n", text)


def repaired(chunks: DataFrame) -> DataFrame:
    """p5_text: chunk_id, defects (sorted array, empty without any), text of every chunk of a scanned document.

    That is a document of which a chunk has a defect or is broken into lines inside its
    sentences. A word cut by the end of a page stands whole on the first page.
    """
    f = Findings(chunks)
    kinds = f.stage.put(f.defects()).groupBy("chunk_id").agg(F.sort_array(F.collect_set("defect")).alias("defects"))
    kinds = f.stage.put(kinds)
    fixes = f.misread.groupBy("chunk_id").agg(F.collect_set(F.struct("gram", "right")).alias("misread"))
    broken = f.broken.groupBy("chunk_id").agg(F.collect_set("value").alias("broken"))
    heads = f.headers.groupBy("chunk_id").agg(F.collect_set("head").alias("headers"))
    pages = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content").where("content is not null")
    scanned = pages.join(kinds.select("chunk_id").unionByName(f.page.select("chunk_id")), "chunk_id", "left_semi").select("document_id").distinct()
    rows = pages.join(scanned, "document_id", "left_semi")
    for more in (kinds, fixes, broken, heads):
        rows = rows.join(more, "chunk_id", "left")
    rows = rows.withColumn("defects", F.coalesce("defects", F.array().cast("array<string>")))

    @F.pandas_udf("string")
    def mend(content: pd.Series, headers: pd.Series, defects: pd.Series, misread: pd.Series, broken: pd.Series) -> pd.Series:
        out = []
        for c, h, d, m, b in zip(content, headers, defects, misread, broken):
            pairs = {x["gram"]: x["right"] for x in m} if m is not None else {}
            out.append(repair(c, list(h) if h is not None else [], "page_no" in d, pairs, set(b) if b is not None else set()))
        return pd.Series(out)

    mended = f.stage.put(rows.select("chunk_id", "document_id", "chunk_index", "defects", mend("content", "headers", "defects", "misread", "broken").alias("text")))
    return across_pages(mended, f.counts)


def across_pages(mended: DataFrame, counts: DataFrame) -> DataFrame:
    """chunk_id, defects, text with the second half of a word moved to the page where it begins.

    A page meets the next one by document and chunk_index; where several chunks claim one
    place nothing is moved.
    """
    letters, marks = f"[{_L}]", "[-¬‐\u00ad]"
    half = F.regexp_extract("text", f"({letters}+){marks}\\s*$", 1)
    first = F.regexp_extract("text", f"^({letters}+)", 1)
    ends = mended.select("document_id", "chunk_index", "chunk_id", half.alias("half"), first.alias("first"))
    alone = ends.groupBy("document_id", "chunk_index").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    ends = ends.join(alone, ["document_id", "chunk_index"])
    here = ends.where("half <> ''").select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("chunk_id").alias("here"), "half")
    pairs = here.join(ends.where("first <> ''").select("document_id", "chunk_index", F.col("chunk_id").alias("there"), "first"), ["document_id", "chunk_index"])
    pairs = pairs.where(F.col("first").rlike("^[a-zß-öø-ÿ]")).withColumn("value", F.lower(F.concat("half", "first"))).withColumn("other", F.lower(F.concat_ws("-", "half", "first")))
    pairs = pairs.join(broken_words(pairs, counts), ["value", "other"], "left_semi")
    rows = mended.join(pairs.select(F.col("here").alias("chunk_id"), F.col("first").alias("_more")), "chunk_id", "left")
    rows = rows.join(pairs.select(F.col("there").alias("chunk_id"), F.col("first").alias("_gone")), "chunk_id", "left")
    text = F.when(F.col("_gone").isNotNull(), F.regexp_replace(F.expr("substring(text, length(_gone) + 1)"), "^\\s+", "")).otherwise(F.col("text"))
    text = F.when(F.col("_more").isNotNull(), F.concat(F.regexp_replace(text, f"{marks}\\s*$", ""), "_more")).otherwise(text)
    return rows.select("chunk_id", "defects", text.alias("text"))
