"""Problem 8: a score for abusive, hateful or sexually explicit language.

A weighted finite-state pattern grammar over the words of a sentence:

1. the disguise step writes masked, spaced, accented or otherwise hidden words plainly;
2. the lexicon transducer writes each word as its class (`lexicon`); a word of no class is ".";
3. three transducers are composed behind it: the target transducer tells persons and groups from
   things ("your mother" but not "your barn", "hill people"), the negation transducer takes
   out what a negation covers, the reported-speech transducer marks what is only quoted;
4. the acceptor `RULES` finds insult, threat, hate and sexual clauses: a target bound to a predicate,
   with a weight. Words alone make no clause; talk about moderation or medicine takes weight away.

Only sentences with a word that some rule needs are read word by word; they are found with one
Aho-Corasick automaton, so the cost of a text doesn't grow with the lexicon. A document's score
joins its clauses as independent evidence. Everything is one pass over the text where it is
read; nothing is shuffled but the counts of the rates.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import lexicon
from docloom.llm.automata import Grammar, compose

#: Documents with this score or more have such content.
THRESHOLD = 0.5

#: Names for several classes in the patterns below.
SETS = {
    "a": "a|die|very",
    "WILL": "will|orelse",
    "ALL": "GROUP|PEOPLE",
    "INSULT": "slur|beast|base",
    "VILE": "slur|beast|base|mean",
    "PAIN": "hurt|exterminate|finish|torch",
    "KILL": "exterminate|hurt|torch",
    "TOUCH": "touch|touch-ed|touch-s",
    "RUDE": "sexact|nude|aroused|sexpart",
    "LEWD": "sexact|porn|nude|aroused|sexpart|touch|touch-ed|touch-s|naked",
    "DISMISS": "dismiss|begone",
    "END": ">|,|;",
}

#: The clause grammar, kind -> lines of a weight and a pattern (see ``automata.Grammar``).
RULES: dict[str, str] = {
    # a person called a name or given a base quality; cursed, dismissed, wished dead; threatened
    "abusive": """
        0.90 YOU be a* ..2 slur
        0.85 YOU be a* mean* INSULT
        0.90 YOU a* mean* slur
        0.70 YOU . slur
        0.85 YOU a* mean mean* INSULT
        0.75 < YOU a* beast
        0.70 , YOU a* beast END
        0.70 YOU|your ..1 mean mean* slur
        0.60 YOU ..2 a mean mean* beast
        0.65 YOU be a* mean
        0.60 YOU mean mean* END
        0.80 THEM|kin-of be a* ..1 slur
        0.75 THEM|kin-of be a mean* beast
        0.60 THEM be a* mean a? mean
        0.80 THEM slur
        0.75 PEOPLE be a* mean* slur
        0.75 this a* mean* slur
        0.70 this a* mean* beast ..8 DISMISS|die
        0.70 a? born mean* INSULT
        0.75 a mean mean* slur
        0.70 mean mean* slur
        0.60 < a* mean mean* beast END
        0.65 < a a beast will
        0.75 kin-of be a* mean* INSULT
        0.65 < a* slur END
        0.65 < a a* slur
        0.75 slur YOU
        0.85 curse a* YOU|your|kin-of
        0.80 curse ..1 slur
        0.60 curse curse
        0.75 DISMISS ..6 VILE
        0.70 slur ..8 DISMISS
        0.65 DISMISS ..1 YOU
        0.65 YOU ..4 DISMISS
        0.60 begone
        0.55 <|,|; a? DISMISS
        0.75 nobody ..2 want ..1 YOU
        0.70 nobody WILL want YOU
        0.70 nobody ..1 YOU want
        0.75 nobody WILL YOU want
        0.90 hope ..1 YOU|THEM will? ..2 die|hurt|suicide
        0.85 YOU|THEM must ..2 die|suicide
        0.85 why neg? YOU ..1 die|suicide
        0.80 YOU why ..3 die|suicide
        0.75 suicide END
        0.75 YOU will ..3 suicide
        0.65 < find? jump ..3 high
        0.65 if|must|why|hope YOU ..1 jump|jump-ed ..3 high
        0.65 YOU must|why|will ..2 jump ..3 high
        0.90 kin-of|your|THEM must ..2 hurt-ed|hurt YOU
        0.80 slur ..3 die
        0.80 die a* mean* slur
        0.95 ME be? will ..2 KILL YOU|your
        0.60 ME be? will ..2 hurt THEM
        0.90 ME ..1 KILL YOU
        0.90 ME be? will ..8 PAIN YOU
        0.80 orelse ..1 KILL YOU|your
        0.90 orelse|ME ..3 hurt your ..1 part
        0.90 hurt YOU ..1 part
        0.80 WILL ..1 hurt THEM ..1 part
        0.90 ME bring YOU um
        0.85 WILL bring YOU um
        0.80 ME ..3 find ..2 where YOU live
        0.90 hurt ME YOU ..1 part
        0.90 ME|WILL ..1 beat YOU|THEM away
        0.85 ME ..1 find ..1 your ..3 torch|PAIN
        0.80 ME ..2 find YOU ..3 PAIN
        0.80 ME be? will ..8 torch ..2 home
        0.80 ME|orelse ..6 torch your|YOU
        0.75 YOU WILL regret
        0.60 warn END
        0.70 warn ..3 YOU|VILE
        0.70 YOU be a* dead""",
    # a group of people called base, to be harmed or shut out
    "hateful": """
        0.90 ALL ..4 be ..3 INSULT
        0.85 ALL ..2 be ..2 worse INSULT
        0.85 ALL ..3 born ..2 VILE
        0.75 GROUP be ..2 mean
        0.70 mean mean* GROUP
        0.85 mean ..1 INSULT ALL
        0.75 ALL ..1 a* mean mean* INSULT
        0.85 ALL ..6 base
        0.80 base ..2 ALL
        0.75 beast ..1 from? a? GROUP
        0.95 ALL ..4 must ..4 harm
        0.90 GROUP ..2 must ..3 exterminate|exterminate-ed|hurt-ed
        0.85 must ..2 exterminate|throw a* .? GROUP
        0.85 <|,|;|must KILL a* .? mean* GROUP
        0.85 WILL ..1 KILL a* GROUP
        0.85 throw a* mean* GROUP ..4 away
        0.85 ALL ..8 throw|KILL THEM ..2 away
        0.75 < a* GROUP away END
        0.75 < away ..1 a* GROUP
        0.80 ALL DISMISS
        0.80 < a* GROUP harm END
        0.90 ALL ..4 neg ..1 right
        0.90 ALL ..4 right ..3 harm|exterminate-ed|hurt-ed|die
        0.90 ALL ..1 unfit
        0.80 ALL ..4 must|will neg ..2 allowed
        0.80 GROUP must|be neg ..1 welcome
        0.80 neg a* welcome a* mean* GROUP
        0.80 unwelcome a* GROUP
        0.80 GROUP ..1 unwelcome
        0.75 neg ..1 throw a* GROUP ..3 away
        0.80 blame ..6 from a* GROUP
        0.80 blame ..4 blame a* GROUP
        0.70 GROUP be ..3 blame
        0.80 GROUP ..4 breed ..2 INSULT
        0.80 GROUP ..4 worse INSULT ..1 breed
        0.80 made ..3 ALL ..6 menial
        0.80 GROUP ..1 be? made ..4 menial
        0.85 hope a* GROUP must? ..1 die|harm
        0.80 GROUP ..1 must ..2 die
        0.80 GROUP be neg ..1 PEOPLE""",
    # explicit descriptions and solicitation
    "sexual": """
        0.85 TOUCH ..5 sexpart
        0.80 TOUCH ..8 sexact|nude|aroused
        0.75 sexpart ..5 TOUCH
        0.75 aroused ..6 TOUCH
        0.80 RUDE ..8 RUDE
        0.80 porn ..9 sexact|sexword|TOUCH|nude|naked
        0.75 porn ..3 porn
        0.70 porn ..2 film
        0.75 sexact ..9 porn|film
        0.85 throw|solicit|find ..4 nude
        0.80 ME ..3 sexact|nude|aroused ..3 YOU
        0.75 ME be a* aroused
        0.80 ME ..3 touch YOU ..3 LEWD|bed
        0.75 YOU ..3 bed ..4 LEWD
        0.75 want|solicit|will ..3 sexact
        0.80 want|solicit|will ..3 sexword ..2 YOU|bed
        0.75 naked ..4 TOUCH|sexpart
        0.75 TOUCH ..4 naked
        0.75 THEM ..4 sexact
        0.65 YOU ..3 sexact
        0.70 sexact ..4 bed|TOUCH|THEM
        0.75 TOUCH ..3 TOUCH ..6 TOUCH|sexpart""",
}

#: What takes weight from every clause of a sentence: talk about such language, or medicine.
CONTEXT = {"abusive": {"meta": -0.5}, "hateful": {"meta": -0.5}, "sexual": {"meta": -0.5, "med": -0.45}}

_HARSH = {"slur", "beast", "base", "mean", "curse", "dismiss", "begone", "die", "suicide", "jump", "hurt", "hurt-ed", "exterminate", "exterminate-ed", "harm", "torch", "finish", "warn", "breed", "menial", "sexact", "nude", "aroused", "touch"}
_BREAK = {",", ";", "but", "orelse", "<", ">"}
_STARTS = {"you": "YOU", "they": "THEM", "i": "ME", "group": "GROUP"}


def _target(state, symbol):
    """Persons and groups: state is None, "your", "my" or "this" (a possessive or demonstrative came before; "that" with one word since)."""
    if symbol in _STARTS:
        return [(_STARTS[symbol], 0.0, None)]
    if symbol == "people":
        return [("GROUP" if state in ("this", "that") else "PEOPLE", 0.0, None)]
    if symbol == "kin":
        return [("kin-of" if state else ".", 0.0, None)]
    if symbol == "person":
        return [("THEM" if state else ".", 0.0, None)]
    if symbol in ("your", "this", "my"):
        return [(symbol, 0.0, symbol)]
    if symbol == "." and state == "this":
        return [(symbol, 0.0, "that")]
    return [(symbol, 0.0, state if symbol in ("mean", "very", "a") else None)]


def _negation(state, symbol):
    """Takes out harsh words within six symbols of a negation. State: what is left of that, or of the three symbols after "why" that suspend it as -n."""
    left = state or 0
    if symbol in _BREAK:
        return [(symbol, 0.0, None)]
    if symbol == "why":
        return [(symbol, 0.0, -3)]
    if symbol in ("neg", "nobody"):
        return [(symbol, 0.0, left if left < 0 else 6)]
    return [("." if left > 0 and symbol in _HARSH else symbol, 0.0, left - 1 if left > 0 else left + 1 if left < 0 else None)]


def _reported(state, symbol):
    """Marks harsh words inside quotation marks, or after a verb of saying whose subject isn't the speaker."""
    if symbol in ("open", "close"):
        return [(",", 0.0, "quoted" if symbol == "open" else None)]
    if state == "quoted":
        return [("~" + symbol if symbol in _HARSH else symbol, 0.0, state)]
    if symbol in (";", "<", ">"):
        return [(symbol, 0.0, None)]
    if symbol == "say":
        return [(symbol, 0.0, None if state == "me" else "said")]
    if state == "said":
        return [("~" + symbol if symbol in _HARSH else symbol, 0.0, state)]
    return [(symbol, 0.0, "me" if symbol == "ME" else None)]


#: fixed values: Cyrillic and Greek letters that look like Latin ones, and digits and signs written for letters
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏкмтвнαοερτυνικ", "aeopcyxijsdhlkmtbhaoeptuvik")
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "0": "o", "1": "i", "5": "s", "7": "t", "$": "s", "!": "i", "|": "l"})
_INVISIBLE = ("​", "‌", "‍", "⁠", "﻿", "­", "‎", "‏")
_HAN = "㐀-鿿"

_BROKEN = re.compile(r"[-¬‐‑](?<=[^\W\d_].)[ \t]*\n[ \t]*(?=[^\W\d_])")
_HAN_GAP = re.compile(rf"(?<=[{_HAN}])(?:[ \t]{{0,3}}\n[ \t　]*(?!\n)|[ \t*·•_~.\-|/]{{1,2}})(?=[{_HAN}])")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W\d_])")
_SIGN = re.compile(r"[@$0134578!](?<=[a-zäöüß].)|[@$0134578](?=[a-zäöüß])")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzäöüß@$0134578!")
_PERHAPS_SPACED = re.compile(r" \w \w ")
_MASKED = re.compile(r"[^\W\d_]\*{1,12}[^\W\d_]+|[^\W\d_]+\*{1,12}[^\W\d_]")
_END = re.compile(r"[.!?](?:[\s\"'”’]|(?=[㐀-鿿])|$)|[。！？]\s?|\n\s*\n")
_WORD = re.compile(rf"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[,，、;；:：—–]|(?<!\w)[\"“„«](?=\w)|(?<=[\w.!?,])[\"”“»](?!\w)")
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_HAN_RUN = re.compile(rf"[{_HAN}]+")
_FILL = 9  # fillers in a row beyond this say no more


@functools.cache
def _needs() -> list[list[set[str]]]:
    """For each rule without an item of rare classes, the items (as sets of classes) that a sentence must have for it."""
    plain_name = {"GROUP": "group", "PEOPLE": "people"}
    out = []
    for text in RULES.values():
        for line in text.split("\n"):
            items = [i for i in line.split()[1:] if i[-1] not in "?*" and not i.startswith("..")]
            sets = [{c for n in i.split("|") for m in SETS.get(n, n).split("|") for c in SETS.get(m, m).split("|")} for i in items]
            if items and not any(i <= _RARE for i in sets):
                out.append([{plain_name.get(c, c) for c in i} for i in sets if not i & _PLENTY])
    return out


@functools.cache
def _lexicon():
    """(class of each form, phrases by first word, longest Han form, automaton of words that rules need, automaton of all words, masked forms, classes by the longest word of a Latin form, automaton of the Chinese ones among them)."""
    import ahocorasick

    found = lexicon.classes()
    phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for form, name in found.items():
        if " " in form:
            first, *more = form.split()
            phrases.setdefault(first, []).append((tuple(more), name))
    for some in phrases.values():
        some.sort(key=lambda p: -len(p[0]))
    hot, han, every, keys = ahocorasick.Automaton(), ahocorasick.Automaton(), ahocorasick.Automaton(), {}
    masked: dict[tuple[str, str, int], str] = {}
    for form, name in found.items():
        every.add_word(form, len(form))
        if name in _RARE or any(name in item for need in _needs() for item in need):
            hot.add_word(form, (len(form), name))
            if form[0] < "㐀":
                first, *more = sorted(_LATIN.findall(form), key=len, reverse=True)
                keys.setdefault(first, set()).add((name, frozenset(more)))
            else:
                han.add_word(form, name)
            if " " not in form and name in _MASKABLE:
                masked.setdefault((form[0], form[-1], len(form)), form)
    hot.make_automaton()
    han.make_automaton()
    every.make_automaton()
    return found, phrases, max(len(f) for f in found if f[0] >= "㐀"), hot, every, masked, keys, han


#: Classes so rare in plain text that one word of them has its sentence read.
_RARE = {
    "slur", "beast", "base", "mean", "curse", "begone", "dismiss", "suicide", "jump", "jump-ed", "hurt", "hurt-ed", "exterminate", "exterminate-ed", "torch", "um", "regret", "warn", "harm", "unfit", "unwelcome",
    "breed", "menial", "born", "sexact", "porn", "nude", "aroused", "sexpart", "touch", "touch-ed", "touch-s", "naked",
}
#: Classes so common that they are no reason to read a sentence.
_PLENTY = {"a", "be", "will", "orelse", "YOU", "THEM", "ME", "your", "this", "neg", "very", "from", "find", "kin-of", "if", ".", ",", ";", "<", ">", "home", "bed", "solicit"}
_MASKABLE = {"slur", "beast", "base", "mean", "curse", "hurt", "die", "sexact", "porn", "nude", "sexpart", "aroused"}


@functools.cache
def _rewrite():
    return compose(compose(_target, _negation), _reported)


@functools.cache
def _grammar() -> Grammar:
    lines = ((kind, *line.split(None, 1)) for kind, text in RULES.items() for line in text.strip().splitlines())
    return Grammar(((kind, float(w), p) for kind, w, p in lines), SETS, CONTEXT)


def plain(text: str) -> str:
    """The text as it would read without disguises: lower case, words whole, letters for signs."""
    for mark in _INVISIBLE:
        if mark in text:
            text = text.replace(mark, "")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if _FOREIGN.search(text):
        text = text.translate(_LOOKALIKE)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _HAN_GAP.sub("", text)
    if "*" in text:
        text = _MASKED.sub(_unmask, text)
    if _SIGN.search(text):
        text = _unsigned(text)
    return _SPACED.sub(_unspace, text) if _PERHAPS_SPACED.search(text) else text


def _unmask(m: re.Match) -> str:
    word = m[0]
    return _lexicon()[5].get((word[0], word[-1], len(word)), word)


def _unsigned(text: str) -> str:
    """Signs between letters as the letters they stand for, where that gives a word of the lexicon."""
    out, done = [], 0
    for m in _SIGN.finditer(text):
        at = m.start()
        if at < done:
            continue
        end = at + 1
        while at > done and text[at - 1] in _LETTERS:
            at -= 1
        while end < len(text) and text[end] in _LETTERS:
            end += 1
        while text[end - 1] == "!":
            end -= 1
        word = text[at:end].translate(_LEET)
        if any(n > 3 for _, (n, *_rest) in _lexicon()[3].iter(word)):
            out += [text[done:at], word]
            done = end
    return "".join([*out, text[done:]])


def _unspace(m: re.Match) -> str:
    """Single letters with spaces between: the known words in them, longest first from the left."""
    word = m[0].replace(" ", "")
    best: dict[int, int] = {}
    for end, n in _lexicon()[4].iter(word):
        if n > 2:
            best[end - n + 1] = max(best.get(end - n + 1, 0), n)
    out, at, loose = [], 0, ""
    while at < len(word):
        if at in best:
            out += [loose, word[at : at + best[at]]]
            loose, at = "", at + best[at]
        else:
            loose, at = loose + word[at], at + 1
    return " ".join(x for x in [*out, loose] if x)


def _han(run: str) -> Iterator[str]:
    """The classes in a run of Chinese, longest match from the left; two unknown characters make one filler."""
    found, _, longest, *_ = _lexicon()
    at, loose = 0, 0
    while at < len(run):
        for n in range(min(longest, len(run) - at), 0, -1):
            name = found.get(run[at : at + n])
            if name:
                yield from "." * ((loose + 1) // 2)
                yield name
                at, loose = at + n, 0
                break
        else:
            at, loose = at + 1, loose + 1
    yield from "." * ((loose + 1) // 2)


def classes(sentence: str) -> list[str]:
    """The class of each word of a plain sentence between "<" and ">"; "." is a word of no class."""
    found, phrases, *_ = _lexicon()
    words: list[str] = []
    for m in _WORD.finditer(sentence):
        w = m[0]
        if w[0] >= "㐀" or not w.isascii() and _HAN_RUN.search(w):
            words.append(w)
        elif "'" in w or "’" in w:
            words += _contracted(w.replace("’", "'"), found)
        else:
            words.append(w)
    out, i, quoted = ["<"], 0, False
    while i < len(words):
        w = words[i]
        i += 1
        if w[0] in '"“”„«»':
            out.append("close" if quoted else "open")
            quoted = not quoted
        elif w[0] in ",，、":
            out.append(",")
        elif w[0] in ";；:：—–":
            out.append(";")
        elif _HAN_RUN.search(w):
            out += _han("".join(_HAN_RUN.findall(w)))
        else:
            for more, name in phrases.get(w, ()):
                if tuple(words[i : i + len(more)]) == more:
                    out.append(name)
                    i += len(more)
                    break
            else:
                out.append(found.get(w, "."))
    return [*out, ">"]


def _contracted(word: str, found: dict[str, str]) -> list[str]:
    if word in found:
        return [word]
    head, _, tail = word.rpartition("'")
    if word.endswith("n't"):
        return ["not"]
    return [head, *{"re": ["are"], "s": ["is"] if head in found else [], "m": ["am"], "ll": ["will"], "d": ["would"], "ve": []}.get(tail, [tail])]


def sentences(text: str) -> Iterator[str]:
    """The sentences of a plain text that hold a word some rule needs."""
    *_, keys, han = _lexicon()
    at = 0
    for stop in (*(m.end() for m in _END.finditer(text)), len(text)):
        sentence = text[at:stop]
        at = stop
        here = set()
        words = set(_LATIN.findall(sentence))
        for word in keys.keys() & words:
            here.update(name for name, more in keys[word] if more <= words)
        if not sentence.isascii():
            here.update(name for _, name in han.iter(sentence))
        if here and (not _RARE.isdisjoint(here) or any(all(here & item for item in need) for need in _needs())):
            yield sentence


def symbols(sentence: str) -> list[str]:
    """The classes after the target, negation and reported-speech transducers, long runs of fillers shortened."""
    step, state, out, fill = _rewrite(), None, [], 0
    for name in classes(sentence):
        fill = fill + 1 if name == "." else 0
        if fill <= _FILL:
            symbol, _, state = step(state, name)[0]
            out.append(symbol)
    return out


@functools.lru_cache(50_000)
def _clause(line: tuple[str, ...]) -> tuple[float, str | None]:
    return _grammar().best(line)


def clause(sentence: str) -> tuple[float, str | None]:
    """(weight from 0 to 1, kind) of one plain sentence's heaviest clause."""
    line = tuple(symbols(sentence))
    return _clause(line) if len(line) < 200 else _grammar().best(line)


def score(text: str | None) -> tuple[float, str | None]:
    """(score, kind of the strongest clause); a null or empty text has score 0."""
    if not text:
        return 0.0, None
    left, best, kind = 1.0, 0.0, None
    for sentence in sentences(plain(text)):
        w, what = clause(sentence)
        if w >= THRESHOLD:  # weaker clauses are no evidence, however many a long text has
            left *= 1 - w
            if w > best:
                best, kind = w, what
    return round(1 - left, 6), kind


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """key, keep, score (0 to 1), kind (of the strongest clause, null where the score is 0).

    Null, empty and blank texts have score 0; repeated rows stay; other columns aren't read.
    """

    @F.pandas_udf("struct<score:double,kind:string>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(t) for t in texts], columns=["score", "kind"])

    rows = documents.select(key, *keep, judge(F.col(text)).alias("_s"))
    return rows.select(key, *keep, "_s.score", "_s.kind")


def abusive_documents(documents: DataFrame) -> DataFrame:
    """p8_found: doc_id."""
    return scored(documents, keep=()).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def source_rates(documents: DataFrame) -> DataFrame:
    """p8_rates: documents, documents with such content and their rate for each source (also null)."""
    flagged = (F.col("score") >= THRESHOLD).cast("long")
    rows = scored(documents).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(flagged).alias("flagged"), F.avg("score").alias("mean_score"))
    return rows.withColumn("rate", F.col("flagged") / F.col("documents"))
