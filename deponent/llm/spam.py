"""Problem 8: keyword-stuffed posts, link lists and heaps of product tags, by the shapes of lines.

A post's own words (quoted text and signature left out) are cut into lines, lines into sentences or
at list separators into pieces. Each piece is reduced to a shape: how many words stand at each of its
links, how many of the words are distinct and how many join others (word counts), how its capitals
fall, which separator it stands at, how many links it has. Pieces are grouped by shape; shapes that
no sentence has are told from the others by their parts alone, and a post is flagged if few of them
dominate it. The same groups are counted over the crawl by ``shape_profile``. No words of any
language or trade are listed; the fixed values below are signs of addresses and of markup.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A post is flagged if dominating shapes hold more than this part of its words ...
MOSTLY = 0.5
#: ... and at least so many words (a link counts as LINK_WORDS).
LEAST_WORDS, LINK_WORDS = 12, 3
#: Words from which a piece can be a sentence; at list separators and in title case it takes LONG_WORDS.
SENTENCE_WORDS, LONG_WORDS, LONGEST_SENTENCE = 5, 9, 30
#: Pieces (a link counts as one) that the shapes of one separator need to dominate.
LIST_PIECES = 4
#: Shapes that can dominate a page together.
FEW_SHAPES = 5
#: In a post with fewer pieces than this that it has already, each sentence is measured once.
REPEATED_PIECES = 8
#: Words that variety is measured over, and the least part of them that are distinct in running
#: words and in sentences that end as such.
CHUNK, DISTINCT, DISTINCT_PROSE = 24, 0.5, 0.4
#: Of HEAP_WORDS and more running words without sentence ends, the least part that have at most
#: SHORT_WORD letters, as words that join others have.
HEAP_WORDS, SHORT_PART, SHORT_WORD = 16, 0.2, 3
#: What a single letter among words that are no prose counts as a repeated word.
LETTER = 0.7
#: Longest signature: lines that aren't blank, and characters.
SIGNATURE_LINES, SIGNATURE_CHARS = 6, 500

# Runs in patterns are possessive and stop at the sign that starts the next match, so a text of any
# length is read in linear time and nothing is bounded.
_MARK = re.compile(r"<(/?)(blockquote|pre|code)\b[^<>]*+>|\[(/?)(quote|code)\b[^\[\]]*+\]|```", re.I)
_CLOCK = re.compile(r"\s*+\[?(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d\b")
_ENTRY = re.compile(r"\w=\S|\w\[\w")
_CODE = re.compile(r"(?: {4,}+|\t++)\S.*[=(){}\[\]]|.*(?:\w\(.*\)\s*+[:;{]|[{}])\s*+\Z|[|+:\-\s]++\Z")
#: Signs that a line that _CODE matches starts or ends with.
_CODE_STARTS, _CODE_ENDS = tuple(" \t|+:-"), tuple(":;{}")
_QUOTED = re.compile(r"\s*+(?:>|&gt;)")
_RULE = re.compile(r"\s*+(?:-{2,3}|—|_{4,}+)\s*+\Z")
_SMALL = re.compile(r"\n\s*+\[size=\d\](?P<in>(?:(?!\[/?size)[^\n])*+)\[/size\]\s*+\Z")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe0f\ufeff]")
_LINK = re.compile(
    r"<a\b[^<>]*+>(?:(?!</?a\b).)*+</a\s*+>|\[url\b[^\[\]]*+\](?:(?!\[/?url\b).)*+\[/url\]|\[url=[^\[\]]*+\]|<a\b[^<>]*+>|!?\[[^\[\]\n]*+\]\((?:https?:|www\.)[^)\s]*+\)?"
    r"|\b(?:https?|hxxps?|ftp)\s?:\s?//[^\s<>\[\]\"]++|\bwww\.[^\s<>\[\]\"]++",
    re.I | re.S,
)
_DOTTED = re.compile(r"(?<![\w.@-])[a-z0-9][a-z0-9-]++(?:\.[a-z0-9-]{2,}+(?=\.[a-z0-9]))*+\.[a-z]{2,}+(?![\w-])(?:/[^\s<>\[\]\"]*+)?")
#: Ways to write the dot of an address.
_DOT = re.compile(r"\s{0,3}(?:\[\.\]|\(\.\)|[\[(](?:dot|punkt|punto|point|ponto)[\])]|(?<=[\w-])\s{1,3}dot\s{1,3}(?=[a-z]))\s{0,3}", re.I)
#: What a text must hold, in lower case, for the patterns of dots and of links to match.
_DOT_SIGNS, _LINK_SIGNS = ("[.]", "(.)", "dot", "punkt", "punto", "point", "ponto"), ("<a", "[url", "](", "http", "hxxp", "ftp", "www.")
_BREAK = re.compile(r"<(?:br|/p|/div|/li|/h[1-6])\b[^<>]*+>", re.I)
_TAG = re.compile(r"</?[a-z][^<>\n]*+>|\[/?[a-z*]++(?:=[^\[\]\n]*+)?\]", re.I)
#: Signs that end a sentence.
_ENDS = ".!?…。！？"
_END = re.compile(r"[.!?…][)\"'»”]*+(?:\s++|\Z)|[。！？][)\"'»”]*+\s*+")
_STRONG = re.compile(r"\s{0,4}(?:\|+|;|[•·★☆►▶✓✔➤→~=]+|/{1,2}(?=\s)|(?<=\s)[-–—*+](?=\s)|\t)\s{0,4}")
_MAY_CUT = re.compile(r"[|;•·★☆►▶✓✔➤→~=/–—*+\t]|-\s")
_COMMA = re.compile(r"\s{0,4}[,、，]\s{0,4}")
_WORD = re.compile(r"\w++(?:['’\-@$]\w++)*+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
#: What a text must hold for the patterns of addresses and of spaced letters to match.
_MAY_DOT, _MAY_SPACE = re.compile(r"\.[a-z]{2}"), re.compile(r" \w \w ")
_HASHED = re.compile(r"(?<![\w&])#[^\W\d]\S*")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: Stands for a link.
LINK = "\ue000"
#: Fixed value: digits and signs that stand for letters in disguised words.
_LEET = str.maketrans("0134578@$", "oieastbas")
_MASKS = re.compile("[0134578@$]")


class Mark(NamedTuple):
    """A sign at which a quote block or a code block starts or ends."""

    start: int
    end: int
    kind: str
    closes: bool  # a fence both opens and closes

    @property
    def quotes(self) -> bool:
        return self.kind in ("[quote", "blockquote")


def _partners(marks: list[Mark]) -> tuple[dict[int, int], dict[int, int]]:
    """Of each start of a quote block and of each start of code, the mark that ends it, if any. Code
    that meets another start of its kind first has none. Marks in code that is closed count for nothing."""
    code: dict[int, int] = {}
    following: dict[str, int] = {}
    for i in range(len(marks) - 1, -1, -1):
        m = marks[i]
        if not m.quotes:
            after = following.get(m.kind)
            if after is not None and (m.kind == "```" or not m.closes and marks[after].closes):
                code[i] = after
            following[m.kind] = i
    quotes: dict[int, int] = {}
    opened: list[int] = []
    at = 0
    while at < len(marks):
        m = marks[at]
        if m.quotes and not m.closes:
            opened.append(at)
        elif m.quotes and opened:
            quotes[opened.pop()] = at
        elif at in code:
            depth, cut = 0, False
            for inner in marks[at + 1 : code[at]]:
                if inner.quotes:
                    depth += -1 if inner.closes else 1
                    cut |= depth < 0
            if not (opened and cut):
                at = code[at]
        at += 1
    return quotes, code


def _without_blocks(text: str) -> str:
    """The text without closed quote blocks and closed code. What never closes is no block: its mark is
    text like any other, so nothing can hide behind it; code that is cut in a quote ends with the
    quote. Of what starts in a quoted line only a quote block counts, as the line is left out itself."""
    if "[" not in text and "<" not in text and "```" not in text:
        return text
    marks = [Mark(m.start(), m.end(), f"[{m[4]}".lower() if m[4] else (m[2] or m[0]).lower(), bool(m[1] or m[3])) for m in _MARK.finditer(text)]
    if not marks:
        return text
    quotes, code = _partners(marks)
    out: list[str] = []
    at = seen = line = 0
    begun, in_quoted = -1, False
    for i, m in enumerate(marks):
        partner = quotes.get(i) if m.quotes else code.get(i)
        if m.start < at or partner is None:
            continue
        line = max(line, text.rfind("\n", seen, m.start) + 1, at)
        seen = m.start
        if begun != line:
            begun, in_quoted = line, bool(_QUOTED.match(text, line))
        if in_quoted and not m.quotes:
            continue
        out += [text[at : m.start], "\n"]
        at = marks[partner].end
    out.append(text[at:])
    return "".join(out)


def _has_link(line: str) -> bool:
    return "://" in line or "www." in line or "](" in line


def _machine_made(line: str) -> bool:
    """A line of a log (it begins with a clock and has an entry such as name=value) or of code, by its
    signs. A line with a link is neither."""
    if line[:1] in _CODE_STARTS or line[-1:] in _CODE_ENDS or line.endswith(" "):
        return not _has_link(line) and bool(_CODE.match(line) or (_CLOCK.match(line) and _ENTRY.search(line)))
    return bool(":" in line and _CLOCK.match(line) and _ENTRY.search(line)) and not _has_link(line)


def _without_signature(lines: list[str]) -> list[str]:
    """The lines before the signature: a rule, after it the last lines of the post, few and short, and
    before it something that they sign."""
    rules = [i for i, line in enumerate(lines) if line[:1] in " -—_" and _RULE.match(line)]
    if rules:
        at = rules[-1]
        signed = [line for line in lines[at + 1 :] if line.strip()]
        if len(signed) <= SIGNATURE_LINES and sum(map(len, signed)) <= SIGNATURE_CHARS and any(line.strip() for line in lines[:at]):
            return lines[:at]
    return lines


def drop_quoted(text: str) -> str:
    """The text without closed quote blocks, quoted lines with the line that announces them, closed
    code, lines of code and logs, and the signature."""
    text = _without_blocks(text.replace("\r\n", "\n").replace("\r", "\n"))
    kept: list[str] = []
    for line in text.split("\n"):
        if (">" in line or "&" in line) and _QUOTED.match(line):
            while kept and not kept[-1].strip():
                kept.pop()
            if kept and kept[-1].rstrip().endswith((":", "：")):
                kept.pop()
        elif not _machine_made(line) or _RULE.match(line):
            kept.append(line)
    own = "\n".join(_without_signature(kept))
    if "[size=" in own and (small := _SMALL.search(own)) and len(small["in"]) <= SIGNATURE_CHARS and own[: small.start()].strip():
        own = own[: small.start()]
    return own


def _holds(text: str, signs: tuple[str, ...]) -> bool:
    for sign in signs:
        if sign in text:
            return True
    return False


def plain(text: str) -> str:
    """Own words in one spelling of characters: entities, compatibility forms, invisible characters
    and markup resolved; links stand as one sign each."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    low = text.lower()  # most posts hold none of the signs that a pattern needs
    if "<" in text:
        text = _BREAK.sub("\n", text)
    if _holds(low, _DOT_SIGNS):
        text = _DOT.sub(".", text)
    if _holds(low, _LINK_SIGNS):
        text = _LINK.sub(f" {LINK} ", text)
    if _MAY_DOT.search(text):
        text = _DOTTED.sub(f" {LINK} ", text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    if _MAY_SPACE.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return text


def _unmasked(w: str) -> str:
    """A word with the letters that digits and signs in it stand for; numbers stay."""
    return w.translate(_LEET) if any(c.isalpha() for c in w) else w


def _words(piece: str, wide: bool) -> list[str]:
    """Words, folded; of scripts without spaces (``wide``: the post has any) two characters count as one."""
    low = piece.lower().replace("_", " ")
    found = _WORD.findall(low)
    if _MASKS.search(low):
        found = [w if w.isalpha() else _unmasked(w) for w in found]
    if wide and _WIDE.search(piece):
        found = [x for w in found for x in ([w[i : i + 2] for i in range(0, len(w), 2)] if _WIDE.search(w) else (w,))]
    return found


def _capitals(piece: str) -> str:
    """How capitals fall: none (a script without them), low, all, title (each word), else some."""
    if piece.islower():
        return "low"
    if piece.isupper():
        return "all"
    if piece.istitle():
        return "title"
    return "none" if piece.lower() == piece.upper() else "some"


class Piece(NamedTuple):
    text: str
    words: list[str]
    links: int
    separator: str  # . (a sentence end), line, - (few pieces of a line), | or , (many), #

    @property
    def weight(self) -> int:
        return len(self.words) + LINK_WORDS * self.links


class Shape(NamedTuple):
    """What a piece is reduced to."""

    words: int  # words at each link: 0 to 4 as 1, or the least of its class (5, 9, 16, 31)
    fresh: bool  # its words are distinct enough
    joined: bool  # enough of its words are short
    capitals: str
    separator: str
    links: int  # 0, 1, or 2 for more

    @property
    def sentence(self) -> bool:
        """Whether sentences have this shape."""
        long = self.separator in "|,#" or (self.capitals == "title" and self.separator != ".")
        return self.fresh and self.joined and self.words >= (LONG_WORDS if long else SENTENCE_WORDS)


def sentences(line: str) -> Iterator[str]:
    """A line cut after the signs that end sentences."""
    at = 0
    for m in _END.finditer(line):
        yield line[at : m.start() + 1]
        at = m.end()
    if at < len(line):
        yield line[at:]


def pieces(own: str) -> list[Piece]:
    """The pieces of a post's own words."""
    out = []
    wide = not own.isascii() and bool(_WIDE.search(own))

    def add(text: str, separator: str) -> None:
        words, links = _words(text, wide), text.count(LINK) if linked else 0
        if links or (words and (words[0][0].isalpha() or any(w[0].isalpha() for w in words))):
            out.append(Piece(text, words, links, separator))

    for line in own.split("\n"):
        line = line.strip()
        if not line:
            continue
        linked = LINK in line
        tags = _HASHED.findall(line) if "#" in line else []
        if len(tags) > 1:
            out += [Piece(t, _words(t, wide), 0, "#") for t in tags]
            line = _HASHED.sub(" ", line)
        for sentence in sentences(line):
            if sentence.count(",") + (sentence.count("、") + sentence.count("，") if wide else 0) >= LIST_PIECES:
                commas = _COMMA.split(sentence)
                listed = len(_words(sentence, wide)) <= 4.5 * len(commas)
            else:
                listed = False
            cut = _STRONG.split(sentence) if _MAY_CUT.search(sentence) else [sentence]
            if not listed and len(cut) == 1:
                add(sentence, "." if sentence[-1] in _ENDS else "line")
                continue
            many = "," if listed else "|" if len(cut) > LIST_PIECES else "-"
            for strong in cut:
                for piece in _COMMA.split(strong) if listed else [strong]:
                    add(piece, many)
    return out


def _prose(p: Piece) -> bool:
    """Of ordinary length and ended as sentences are."""
    return p.separator == "." and SENTENCE_WORDS * max(1, p.links) <= len(p.words) <= LONGEST_SENTENCE


def _poor(words: list[str], least: float) -> list[int]:
    """Where the stretches of CHUNK words begin that use too few distinct ones."""
    out = []
    for at in range(0, len(words), CHUNK):
        chunk = words[max(0, min(at, len(words) - CHUNK)) : at + CHUNK]
        if len(chunk) >= CHUNK // 2 and len(set(chunk)) <= least * len(chunk):
            out.append(at)
    return out


def _stale(found: list[Piece], prose: list[bool]) -> list[bool]:
    """Of each piece, whether most of its words lie in stretches of CHUNK words that use fewer
    distinct ones than running words, or are single letters. A stretch is looked for among the words
    of pieces that are no prose and among all words, where few pieces come again each sentence only once."""
    poor = [0.0] * len(found)
    long = [[] if is_prose else [w for w in p.words if len(w) > 1 or not w.isalpha() or _WIDE.match(w)] for p, is_prose in zip(found, prose)]
    if starts := _poor([w for words in long for w in words], DISTINCT):
        owner = [i for i, words in enumerate(long) for _ in words]
        for at in starts:
            for i in owner[at : at + CHUNK]:
                poor[i] += 1
    if _poor([w for p in found for w in p.words], DISTINCT_PROSE):
        written = [" ".join(p.words) for p in found]
        once = len(written) - len(set(written)) < REPEATED_PIECES
        words, owner, met = [], [], set()
        for i, p in enumerate(found):
            if once and prose[i]:
                if written[i] in met:
                    continue
                met.add(written[i])
            words += p.words
            owner += [i] * len(p.words)
        seen = [0] * len(found)
        for at in _poor(words, DISTINCT_PROSE):
            for i in owner[at : at + CHUNK]:
                seen[i] += 1
        poor = [max(a, b) for a, b in zip(poor, seen)]
    out = []
    for i, p in enumerate(found):
        if not prose[i]:
            poor[i] += LETTER * (len(p.words) - len(long[i]))
        out.append(poor[i] > 0.5 * len(p.words))
    return out


def _joined(p: Piece, prose: bool) -> bool:
    """Whether words that join others, short ones, stand among many. In lists, where sizes and prices
    are short, too, numbers don't count as such."""
    n, listed = len(p.words), p.separator in "|,#"
    if prose or n < (LONG_WORDS if listed else HEAP_WORDS):
        return True
    short = sum(len(w) <= SHORT_WORD and (not listed or w.isalpha()) for w in p.words)
    return short >= SHORT_PART * n or any(_WIDE.match(w) for w in p.words)


def _own_pieces(text: str | None) -> tuple[list[Piece], list[bool], list[bool]]:
    """The pieces of a post's own words, and of each whether it is prose and whether it is stale."""
    found = pieces(plain(drop_quoted(text))) if text else []
    prose = [_prose(p) for p in found]
    return found, prose, _stale(found, prose)


def _grouped(found: list[Piece], prose: list[bool], stale: list[bool]) -> dict[Shape, list[int]]:
    out: dict[Shape, list[int]] = {}
    for p, is_prose, is_stale in zip(found, prose, stale):
        n = len(p.words) // max(1, p.links)
        size = 1 if n < 5 else 5 if n < 9 else 9 if n < 16 else 16 if n <= LONGEST_SENTENCE else 31
        group = out.setdefault(Shape(size, not is_stale, _joined(p, is_prose), _capitals(p.text), p.separator, min(p.links, 2)), [0, 0])
        group[0] += max(1, p.links)
        group[1] += p.weight
    return out


def shapes(text: str | None) -> dict[Shape, list[int]]:
    """The shapes of a post's own words, each with its pieces (a link counts as one) and their weight."""
    return _grouped(*_own_pieces(text))


def dominating(counts: dict[Shape, list[int]]) -> tuple[int, int]:
    """(words that a post's dominating shapes hold, all own words). Shapes that no sentence has dominate
    if those of their separator, with links or without, come in LIST_PIECES pieces or more, or if
    their words are repeated or run on unjoined; of these the FEW_SHAPES heaviest count."""
    listed: dict[tuple[str, bool], int] = {}
    for s, (n, _) in counts.items():
        if not s.sentence:
            for key in ((s.separator, s.links > 0), ("", s.links > 0)):
                listed[key] = listed.get(key, 0) + n
    held = []
    for s, (_, weight) in counts.items():
        if not s.sentence:
            massed = listed["", True] if s.links else listed[s.separator, False]
            if massed >= LIST_PIECES or not (s.fresh and s.joined):
                held.append(weight)
    return sum(sorted(held)[-FEW_SHAPES:]), sum(weight for _, weight in counts.values())


def flagged(counts: dict[Shape, list[int]]) -> bool:
    held, total = dominating(counts)
    return held > MOSTLY * total and held >= LEAST_WORDS


def is_spam(text: str | None) -> bool:
    """Whether a post's own words consist mainly of repeated keywords, links or product tags."""
    found, prose, stale = _own_pieces(text)
    total, written = 0, 0
    for p, is_prose, is_stale in zip(found, prose, stale):
        weight = len(p.words) + LINK_WORDS * p.links
        total += weight
        if is_prose and not is_stale:
            written += weight  # has the shape of a sentence
    if total < LEAST_WORDS or written >= MOSTLY * total:
        return False
    return flagged(_grouped(found, prose, stale))


def spam_documents(documents: DataFrame) -> DataFrame:
    """doc_id of each flagged post.

    No shuffle before the last step: a post's lines are reduced to shapes and grouped where the post
    is read. Defined results: null, empty and blank texts and posts of fewer than LEAST_WORDS own
    words are never flagged; texts are read whole, whatever their length; a null doc_id is left out;
    redelivered rows come out once; an empty table gives no rows; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([is_spam(t) for t in b.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep)], names=["doc_id"])

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return picked.mapInArrow(run, "doc_id bigint").distinct()


_PROFILE = "words int, fresh boolean, joined boolean, capitals string, separator string, links int, sentence boolean"


def shape_profile(documents: DataFrame) -> DataFrame:
    """The shapes of the whole crawl: their parts, whether sentences have them, and how many posts,
    flagged posts, pieces and words have each. Batches are counted before the shuffle, which carries
    a few hundred shapes a batch. Redelivered rows count each time; a null or empty text has none."""
    kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    names = [c.split()[0] for c in _PROFILE.split(", ")]
    counted = ["posts", "flagged", "pieces", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[Shape, list[int]] = {}
            for text in b.column(0).to_pylist():
                counts = shapes(text)
                spam = flagged(counts)
                for shape, (n, weight) in counts.items():
                    group = seen.setdefault(shape, [0, 0, 0, 0])
                    for i, x in enumerate((1, int(spam), n, weight)):
                        group[i] += x
            parts = [pa.array([(*s, s.sentence)[i] for s in seen], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*parts, *(pa.array([g[i] for g in seen.values()], pa.int64()) for i in range(4))], names=[*names, *counted])

    picked = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")
    grouped = picked.mapInArrow(run, f"{_PROFILE}, {', '.join(f'{c} bigint' for c in counted)}").groupBy(*names)
    return grouped.agg(*(F.sum(c).alias(c) for c in counted))
