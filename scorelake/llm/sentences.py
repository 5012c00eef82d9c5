"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

A mark that may end a sentence is judged by what the same word does elsewhere. Unambiguous places tell: a word with a
period at the end of a block ends a sentence; one followed by a lower-case word, a comma or a figure doesn't; a word that
opens a block opens a sentence. A word that is upper-case in the middle of sentences, and never lower-case there, is a
proper name, which may follow an abbreviation; one that is lower-case there is a common word, whose capital tells that a
sentence begins. The evidence of the document itself counts first, then that of the whole corpus, then a short list of
fixed abbreviations. Terminal marks depend on the script.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that don't end a sentence, for corpora too small to show it (fixed values, lower case, no final period).
NONFINAL = frozenset(
    "mr mrs ms dr prof st no nos fig figs sec cf vs approx ca nr abb vgl bzgl z.b d.h dipl.-ing hr fr frl mm mme sra sr srta ud uds dra pág fig núm см рис табл проф им ул e.g i.e".split()
)
FINAL = frozenset("etc usw inc ltd corp jr sr bros κ.λπ u.s u.k a.m p.m".split())
#: Kana that continue a sentence after a quotation (fixed values).
PARTICLES = frozenset("とっはがをにのでもへや")
#: Words before a German ordinal number (fixed values).
BEFORE_ORDINAL = frozenset("im am der die das den dem des vom zum zur beim bis ab seit ins ans jeder jede jedes ihr sein unser".split())
#: Chinese verbs of saying that close an attribution after a quotation (fixed values).
SAYING = re.compile(r"[^。！？“”：，]*?(?:问道|说道|答道|写道|喊道|问|说|道|表示|回答|指出)(?:[。，！？（(]|$)")

OPENERS, CLOSERS = "([{（［【《〈「『“‘«„‚‹\"'", ")]}）］】》〉」』”’»“\"'›"
SURE_CLOSERS = frozenset(")]}）］】》〉」』”’»›")
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "‘": "’", "‹": "›"}
SKIPPED = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_MARKS = re.compile(r"[.!?…。！？｡．؟۔।॥;\u037e]+(?:[ \u00a0\u202f](?=[»!?]))?[.!?…»]*")
_BLANK = re.compile(r"(?:\r\n|[\n\r\x85\u2028\u2029])[ \t\x0b\x0c\xa0\u3000\ufeff]*(?:\r\n|[\n\r\x85\u2028\u2029])|\u2029")
_BREAK = re.compile(r"\r\n|[\n\r\x85\u2028]")
_BULLET = re.compile(r"[ \t\ufeff]*(?:[-*•‣◦▪–—+·][ \t\u00a0]+|\(?(?:\d{1,3}|[A-Za-z])\)[ \t]+)")
_NUMBERED = re.compile(r"[ \t\ufeff]*\d{1,3}(?:\.\d{1,3})*\.[ \t]+")
_HEADING = re.compile(r"[ \t\ufeff]*#{1,6}[ \t]")
_NUMERIC = re.compile(r"[\d.,/:%\-–]*\d[\d.,/:%\-–]*")
_THAI_GAP = re.compile(r"(?<=[ก-๎])[ \t\n\u00a0]+(?=[ก-ๆ])|(?<=[ก-๎])[ \t\n\u00a0]+(?=[^\u0e00-\u0e7f]*[.!?](?:\s|$))")
_THAI = re.compile(r"[ก-๎]")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_FOREIGN = re.compile(r"(?:[A-Za-z][\w-]*?|\d[\d.,]*)(?: v?\d[\d.]*)?\s?[\u3040-\u30ff\u3400-\u9fff]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\s()\[\]{}“”„«»\"‘’,;:!?…。！？]+")


#: A longer run without blanks is no abbreviation, and what stands before its last LONGEST letters decides nothing.
LONGEST = 64
#: Words after a word or comma and one blank, so in the middle of a sentence; words that no period follows.
_INNER, _UNDOTTED = re.compile(r"(?<=[^\W\d_,;][ \n])[^\W\d_]+|(?<=[,;][ \n])[^\W\d_]+"), re.compile(r"[^\W\d_]++(?!\.)")


@lru_cache(100_000)
def _script(c: str) -> str:
    """latin-like cased letters are upper or lower; uncased letters are named by script where rules need it."""
    n = ord(c)
    if 0x3040 <= n <= 0x309F:
        return "hiragana"
    if 0x3400 <= n <= 0x9FFF or 0x30A0 <= n <= 0x30FF or 0x20000 <= n <= 0x3FFFF or n == 0x3005:
        return "cjk"
    if 0xAC00 <= n <= 0xD7A3 or 0x1100 <= n <= 0x11FF:
        return "hangul"
    if 0x0900 <= n <= 0x0DFF:
        return "indic"
    if 0x0E00 <= n <= 0x0EFF:
        return "thai"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    return "letter" if c.isalpha() else "other"


def _quoted(block: str) -> list[tuple[int, int]]:
    """Outermost quotations of a block as (position of the opening, position of the closing mark); unmatched marks are
    not quotations. A straight apostrophe opens only at a word's start and closes only at a word's end."""
    spans: list[tuple[int, int]] = []
    opened: list[tuple[int, str]] = []
    straight = -1
    for m in _QUOTES.finditer(block):
        i, c = m.start(), m[0]
        if opened and c in opened[-1][1]:
            at, _ = opened.pop()
            if not opened and straight < 0:
                spans.append((at, i))
        elif c in PAIRS:
            opened.append((i, PAIRS[c]))
        elif c == '"':
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i))
                straight = -1
    inner = {(a, b) for a, b in spans}
    return sorted(inner)


_QUOTES = re.compile("[“”„«»「」『』\"‹›]")


class Lexicon:
    """Corpus evidence: words whose period never ends a sentence, those whose period can, lower-case openers."""

    def __init__(self, nonfinal: frozenset[str] = frozenset(), final: frozenset[str] = frozenset(), openers: frozenset[str] = frozenset()) -> None:
        self.nonfinal, self.final, self.openers = nonfinal, final, openers


class Evidence:
    """What the words of a document do at unambiguous places."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.inside: dict[str, int] = defaultdict(int)  # word + period, followed by what can't open a sentence
        self.ending: dict[str, int] = defaultdict(int)  # word + period at the end of a block
        self.other: dict[str, int] = defaultdict(int)  # word + period anywhere else
        self.opening: dict[str, int] = defaultdict(int)  # lower-case word that opens a block
        self.after: dict[str, int] = defaultdict(int)  # lower-case word right after a mark, within a block
        self.goes_on: dict[str, list[str]] = defaultdict(list)  # word + period → lower-case words or commas after it

    @cached_property
    def undotted(self) -> frozenset[str]:
        """Words, in lower case, that stand somewhere without a period after them."""
        return frozenset(w.lower() for w in set(_UNDOTTED.findall(self.text)))

    @cached_property
    def inner(self) -> tuple[frozenset[str], frozenset[str]]:
        """(proper names, common words in lower case) by their places in the middle of sentences. Where more than a
        quarter of two dozen words or more are upper-case there (as German nouns are), capitals tell no names."""
        words = _INNER.findall(self.text)
        kinds = set(words)
        low = frozenset(w for w in kinds if w[0].islower())
        names = frozenset(w for w in kinds if w[0].isupper() and w.lower() not in low)
        many = len(words) >= 24 and sum(w[0].isupper() for w in words) * 4 > len(words)
        return (frozenset(), frozenset()) if many else (names, low)

    def abbreviation(self, key: str, lexicon: Lexicon) -> bool:
        """Whether the document shows that ``key`` with a period doesn't end sentences: a comma or a lower-case word that
        opens none follows it, as often as an upper-case word, and it never stands without its period. Figures and
        compounds (iOS-like) after it tell nothing."""
        sure = sum(w == "," or w not in self.opening and w not in lexicon.openers and "-" not in w for w in self.goes_on.get(key, ()))
        return sure > 0 and sure >= self.other.get(key, 0) and key not in self.undotted


def _blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the blocks of a text; kind is prose or unit (a heading or list item, one sentence)."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip(SKIPPED):
            yield from _lines(text, at, end)
        if m is None:
            return
        at = m.end()
        while (again := _BLANK.match(text, at - 1)) and again.end() > at:
            at = again.end()


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    pieces, at = [], start
    for m in _BREAK.finditer(text, start, end):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, end))
    kind, first, last = "", start, start
    for a, b in pieces:
        line = text[a:b]
        if not line.strip(SKIPPED):
            continue
        before = text[first:last].rstrip(SKIPPED)
        if _HEADING.match(line):
            now = "heading"
        elif _BULLET.match(line) and (line.lstrip(SKIPPED)[0] not in "–—" or kind in ("", "item")) and not (line.lstrip(SKIPPED)[0].isalpha() and kind == "prose"):
            now = "item"
        elif _NUMBERED.match(line) and (kind in ("", "item", "heading") or before[-1:] in tuple(":.!?。！？：")) and not (kind in ("", "heading") and b == end and re.match(r"[ \t\ufeff]*\d{1,3}\.[ \t]+[A-ZÄÖÜ]\w+ [a-zäöü]", line) and len(line) > 90):
            now = "item"
        elif kind == "item":
            now = "more" if before[-1:] not in tuple(".!?。！？") or line[:1] in " \t" else "prose"
        elif kind == "prose":
            now = "more"
        else:
            now = "prose"
        if now == "more":
            last = b
            continue
        if kind:
            yield first, last, "prose" if kind == "prose" else "unit"
        kind, first, last = now, a, b
    if kind:
        yield first, last, "prose" if kind == "prose" else "unit"


def _word_before(text: str, start: int, at: int) -> str:
    """The word that ends at ``at`` (where its period stands), without brackets and quotation marks around it."""
    low = max(start, at - LONGEST)
    i = max(text.rfind(" ", low, at), text.rfind("\n", low, at), low - 1) + 1
    word = text[i:at]
    if not word.isascii() or "\t" in word:  # other white space
        word = "" if word[-1:].isspace() else (word.split() or [""])[-1]
    return word.strip("()[]{}（）“”„«»\"'‘’*_`,;:—–。！？、，：「」\ufeff\u200b")


def _next(text: str, at: int, end: int) -> int:
    while at < end and text[at] in SKIPPED:
        at += 1
    return at


def _opens(text: str, i: int, end: int, abbreviation: bool) -> str:
    """How the text at ``i`` may open a sentence: yes, lower (a lower-case word) or no."""
    c = text[i]
    s = _script(c)
    if s == "other":
        if c in "¿¡#`$€£@<§&%=~^|\\/":
            return "yes" if c not in "&%/=|" else "no"
        if c in OPENERS or c in "*_":
            j = i
            while j < end and (text[j] in OPENERS or text[j] in SKIPPED or text[j] in "*_"):
                j += 1
            return _opens(text, j, end, abbreviation) if j < end else "no"
        return "no" if c in ",;:—–-)]}»”’、，；：·" else "yes"
    return "lower" if s == "lower" else "yes"


def _opening_word(text: str, i: int, end: int) -> str:
    m = _WORD.search(text, i, end)
    return m[0].rstrip(".").lower() if m else ""


def _is_initial(word: str) -> bool:
    tail = word.rpartition(".")[2].rpartition("-")[2]
    return len(tail) == 1 and tail.isalpha() and _script(tail) not in ("cjk", "hangul", "hiragana")


def _ends(text: str, start: int, first: int, mark: str, at: int, end: int, opened: int, lexicon: Lexicon, own: Evidence) -> bool:
    """Whether the mark at ``first``, whose closing marks reach to ``at``, ends the sentence that began at ``start``."""
    i = _next(text, at, end)
    if i >= end:
        return True
    gap, c, wide = i > at, text[i], mark[-1] in "。！？｡．" or mark[0] in "。！？｡．"
    s, closing = _script(c), at > first + len(mark) or text[at - 1] in CLOSERS
    if mark[0] in ";\u037e":
        letter = _LETTER.search(text, start, first)
        return letter is not None and "Ͱ" <= letter[0] <= "\u1fff" and gap and (s != "lower" or _known(text, i, end, lexicon, own))
    if mark.strip("….") == "" and ("…" in mark or len(mark) > 1):
        return gap and s == "upper"
    if wide:
        if c in "，、；：,;:）)」』”" or closing and not gap and (c in PARTICLES or s == "hangul"):
            return False
        if closing and opened == _next(text, start, end) and text[opened] in "“「『" and SAYING.match(text, i, end):
            return False
        return True
    if mark[0] in "।॥۔":
        return c not in ",;:)"
    if closing and not gap and (c in PARTICLES or s == "hangul"):
        return False
    how = _opens(text, i, end, False)
    if how == "no":
        return False
    if not gap and _then_cjk(text, start, first, at, end):
        return True
    if not gap:
        return s in ("cjk", "hiragana") or closing and s == "upper" and "." not in mark or (c in "“「『《«¿¡" and how == "yes")
    known = how == "lower" and _known(text, i, end, lexicon, own)
    if mark[0] != "." or len(mark) > 1 and mark.strip(".») "):
        return how == "yes" or known
    word = _word_before(text, start, first)
    if not word:
        return how == "yes"
    tail = _script(word[-1])
    if tail == "hangul":
        return True
    if how == "lower" and not known:
        return False
    if tail in ("indic", "thai"):
        return False
    if tail == "digit" and _NUMERIC.fullmatch(word):
        before = _word_before(text, start, first - len(word) - 1).lower() if text[first - len(word) - 1 : first - len(word)].isspace() else ""
        return not (s == "upper" and word.isdigit() and len(word) <= 2 and before in BEFORE_ORDINAL)
    if not word[-1].isalpha():
        return True
    if _is_initial(word):
        before = _word_before(text, start, _back(text, first - len(word), start))
        if word == "г" and _NUMERIC.fullmatch(before) or word in ("д", "п") and before.lower() in ("т.", "т"):
            return how == "yes" or known
        return "." in word and _plain(word, text, i, lexicon, own) and s == "upper"
    return _plain(word, text, i, lexicon, own)


def _known(text: str, i: int, end: int, lexicon: Lexicon, own: Evidence) -> bool:
    """Whether the lower-case word at ``i`` is known to open sentences."""
    word = _opening_word(text, i, end)
    return own.opening.get(word, 0) > 0 or word in lexicon.openers


def _then_cjk(text: str, start: int, first: int, at: int, end: int) -> bool:
    """Whether a sentence in another script ends here without a blank and one in Chinese or Japanese follows that begins
    with a name, a figure or an identifier."""
    last = text[first - 1 : first]
    if not (last.isalpha() or last in "%)]”»\"'" or at > first + 1 or last.isspace() or last.isdigit() and text[at].isupper()):
        return False
    return _FOREIGN.match(text, at, end) is not None and (text[first] in "?!" or text.count(" ", start, first) >= 2) and _CJK.search(text, start, first) is None


def _back(text: str, at: int, start: int) -> int:
    while at > start and text[at - 1].isspace():
        at -= 1
    return at


_CAPITAL = re.compile(r"[^\W\d_]+")


def _plain(word: str, text: str, i: int, lexicon: Lexicon, own: Evidence) -> bool:
    """Whether a period after ``word`` ends a sentence before the text at ``i``: by the document, then the corpus, then the
    fixed lists. After an abbreviation a common word with a capital still begins a sentence. A short word with a capital
    that is unknown and never stands without its period is an abbreviation (a title) before a proper name."""
    key = word.lower()
    if own.ending.get(key):
        return True
    shown = own.abbreviation(key, lexicon)
    if not shown and key in lexicon.nonfinal:
        shown = True
    elif key in lexicon.final or key in FINAL:  # abbreviations that also end sentences (etc.)
        return True
    elif not shown and key not in NONFINAL:
        m = _CAPITAL.match(text, i) if len(word) <= 4 and word[0].isupper() and word.isalpha() else None
        return m is None or not m[0][0].isupper() or m[0] not in own.inner[0] or key in own.undotted
    m = _CAPITAL.match(text, i) if text[i].isupper() else None
    return m is not None and m[0].lower() in own.inner[1] and m[0] not in own.inner[0] and key not in NONFINAL


def gathered(text: str) -> Evidence:
    """The evidence of one text."""
    found = Evidence(text)
    for start, end, kind in _blocks(text):
        if kind != "prose":
            continue
        i = _next(text, start, end)
        if i < end and _script(text[i]) == "lower":
            found.opening[_opening_word(text, i, end)] += 1
        for m in _MARKS.finditer(text, start, end):
            at = m.end()
            while at < end and text[at] in CLOSERS:
                at += 1
            i = _next(text, at, end)
            s = _script(text[i]) if i < end else ""
            if i > at and s == "lower":
                found.after[_opening_word(text, i, end)] += 1
            if m[0] != ".":
                continue
            word = _word_before(text, start, m.start()).lower()
            if word and len(word) < LONGEST and not word[-1].isdigit():
                if i >= end:
                    found.ending[word] += 1
                elif i > at or s == "other":
                    on = s == "lower" or text[i] in ",;:"
                    (found.inside if on or s == "digit" else found.other)[word] += 1
                    if on:
                        found.goes_on[word].append(_opening_word(text, i, end) if s == "lower" else ",")
    return found


def sentences(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points; white space and byte-order marks around it are left out. Null,
    empty and blank texts have none. Sentences never overlap and hold every other character of the text."""
    if not text:
        return []
    lexicon, own, found = lexicon or Lexicon(), gathered(text), []

    def add(a: int, b: int) -> None:
        while a < b and text[a] in SKIPPED:
            a += 1
        while b > a and text[b - 1] in SKIPPED:
            b -= 1
        if a < b:
            found.append((a, b))

    for start, end, kind in _blocks(text):
        if kind == "unit":
            add(start, end)
            continue
        block = text[start:end]
        quotes = [(a + start, b + start) for a, b in _quoted(block)] if _QUOTES.search(block) else []
        closing = {b for _, b in quotes}
        gaps = [(m.start(), m.end()) for m in _THAI_GAP.finditer(text, start, end)] if _THAI.search(block) else []
        marks = [(m.start(), m.group()) for m in _MARKS.finditer(text, start, end)]
        at, q, points = start, 0, sorted([(p, m, None) for p, m in marks] + [(a, "", b) for a, b in gaps])
        for first, mark, gap_end in points:
            if first < at:
                continue
            while q < len(quotes) and quotes[q][1] < first:
                q += 1
            inside = q < len(quotes) and quotes[q][0] < first < quotes[q][1]
            if gap_end is not None:
                if not inside:
                    add(at, first)
                    at = gap_end
                continue
            stop, opened = first + len(mark), -1
            while stop < end and (text[stop] in SURE_CLOSERS or stop in closing or text[stop] == "'" and not text[stop + 1 : stop + 2].isalnum()):
                stop += 1
            if inside:
                if stop <= quotes[q][1]:
                    continue  # within a quotation
                opened = quotes[q][0]
            if _ends(text, at, first, mark, stop, end, opened, lexicon, own):
                add(at, stop)
                at = stop
        add(at, end)
    return found


def corpus_evidence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all texts: kind (inside, ending, other, opening, after), word, n. Combined inside each task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            made = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, names=["kind", "word", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    own = gathered(text)
                    for kind in ("inside", "ending", "other", "opening", "after"):
                        for word, n in getattr(own, kind).items():
                            counts[kind, word] += n
            if len(counts) > 200_000:
                yield out()
        yield out()

    return docs.select(text_col).mapInArrow(parse, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def decided(evidence: DataFrame, least: int = 15, rare: float = 0.01) -> DataFrame:
    """What the corpus decides of each word: word, verdict (nonfinal, final or opener); other words have no row.

    A word with ``least`` periods that end a block at a rate under ``rare`` is nonfinal; one that ends blocks although it
    is often followed by lower case is final. A lower-case word is an opener if it opens blocks at a tenth of the rate of
    its places after a mark, or more, and at least twice.
    """
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    words = evidence.groupBy("word").agg(*(of(k).alias(k) for k in ("inside", "ending", "other", "opening", "after")))
    n = F.col("inside") + F.col("ending") + F.col("other")
    period = F.when((n >= least) & (F.col("ending") < rare * n), "nonfinal").when((F.col("ending") > 0) & (F.col("inside") > 0), "final")
    opener = F.when((F.col("opening") >= 2) & (F.col("opening") >= 0.05 * (F.col("opening") + F.col("after"))), "opener")
    return words.select("word", F.explode(F.array_compact(F.array(period, opener))).alias("verdict"))


def lookups(text: str) -> set[str]:
    """All words that ``sentences`` may look up in the lexicon, wherever its sentences begin."""
    found: set[str] = set()
    for start, end, kind in _blocks(text):
        if kind != "prose":
            continue
        for m in _MARKS.finditer(text, start, end):
            first, at = m.span()
            found.add(_word_before(text, start, first).lower())
            for i in range(first - 1, max(start, first - LONGEST), -1):  # a sentence may begin within the word
                if text[i].isspace():
                    break
                if text[i - 1] in CLOSERS or text[i - 1] in SURE_CLOSERS or _MARKS.match(text[i - 1]):
                    found.add(_word_before(text, i, first).lower())
            while at < end:
                i = _next(text, at, end)
                if i < end:
                    found.add(_opening_word(text, i, end))
                if text[at] not in SURE_CLOSERS and text[at] not in CLOSERS:
                    break
                at += 1
    return found


#: A lexicon of so many words (a few MB) goes to every task; a larger one is joined to the documents instead.
LEXICON_BOUND = 200_000


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sentence: the id, sent_start INT, sent_end INT (exclusive), counted in code points.

    Every text counts for the corpus evidence and every text is split whole. Null, empty and blank texts give no rows;
    repeated ids give repeated rows; a null id is kept.
    """
    verdicts = decided(corpus_evidence(docs, text_col))
    head = verdicts.limit(LEXICON_BOUND + 1).collect()
    if len(head) <= LEXICON_BOUND:
        held = {v: frozenset(r["word"] for r in head if r["verdict"] == v) for v in ("nonfinal", "final", "opener")}
        rows = docs.select(id_col, text_col, F.lit(None).cast("array<struct<word:string,verdict:string>>").alias("__own"))
    else:
        held = {v: frozenset() for v in ("nonfinal", "final", "opener")}
        keyed = docs.select(id_col, text_col).withColumn("__row", F.sha2(text_col, 256))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column(0), batch.column(1)):
                    if text.is_valid:
                        wanted = list(lookups(text.as_py()))
                        yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(wanted), pa.string()), pa.array(wanted, pa.string())], names=["__row", "word"])

        asked = keyed.select("__row", text_col).mapInArrow(words, "__row string, word string")
        own = asked.join(verdicts, "word").groupBy("__row").agg(F.collect_set(F.struct("word", "verdict")).alias("__own"))
        rows = keyed.join(own, "__row", "left").select(id_col, text_col, "__own")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Lexicon(held["nonfinal"], held["final"], held["opener"])
        for batch in batches:
            src: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, (text, own) in enumerate(zip(batch.column(1), batch.column(2))):
                mine = own.as_py()
                lexicon = shared if not mine else Lexicon(*(frozenset(r["word"] for r in mine if r["verdict"] == k) for k in ("nonfinal", "final", "opener")))
                for a, b in sentences(text.as_py(), lexicon):
                    src.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "sent_start", "sent_end"])

    return rows.mapInArrow(parse, f"{id_col} {dict(docs.dtypes)[id_col]}, sent_start int, sent_end int")
