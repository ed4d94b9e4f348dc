"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming.

A text is cut into units by its layout: blank lines, listing lines, list items, and runs of lines with the same comment or
quote mark. Inside a paragraph, every place where a sentence could end is a node, and every span between two
nodes is a possible sentence. A span is scored as a whole: how it closes (the mark, the word before it, an
abbreviation or an initial), how the next one opens, how long it is, and whether quotations and brackets in it are balanced
or are the span itself. The best sequence of spans is found from left to right. What a span adds depends on where it begins only if it is very short or begins at the
quotation it closes; of all other starts only the one with the best total can win. So a handful of starts is tried at each node, the sequence is the best of all there are,
and the time is linear in the length of the text.

Offsets count code points from 0, the end is exclusive. Null, empty and blank texts have no sentences. A text without marks is one sentence
per paragraph. Repeated texts give the same sentences for each document.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations in lower case without the last full stop. The first never end a sentence; the second end one
# before a capital; the third only introduce a number.
NEVER = set(
    """mr mrs ms dr prof st rev hon gen col sgt capt lt messrs vs cf approx e.g i.e viz al fig figs sec secs eq eqs ch tab vol ed eds resp incl excl dept est u.s u.k
    abb vgl bzw ca nr hr fr frl str bsp evtl ggf inkl exkl zzgl abs art kap mio mrd sog tel z.b d.h u.a z z.t o.ä i.d.r geb dipl ing
    m mm mme mlle env p.ex ex éd chap av bd réf tél
    sr sra srta dra ud uds aprox pág págs núm fig ej p.ej ee cap vid ver tel
    рис стр см ок табл гл им тыс млн млрд напр т.е ул проф акад г-н ср
    π.χ δηλ βλ σελ εικ αρ κ δρ πρβλ
    डॉ श्री""".split()
)
BEFORE_CAPITAL = set("""etc inc ltd co corp jr sr. a.m p.m usw usf u.ä и.т.д и.др т.д т.п др пр κ.λπ κ.ά κ.ο.κ cía s.a gmbh ag bros""".split())
BEFORE_NUMBER = set("no nos p pp n art c s § № № g gg г стр v ver version".split())
# German words after which a number with a full stop is an ordinal.
ORDINAL_AFTER = set("der die das dem den des am im vom zum zur beim ab bis seit und jeder jede jedes".split())
# Particles that go on with a sentence after a quotation in Japanese.
PARTICLES = tuple("と な の が は を に で も へ や か だ で".split())

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_MARK = re.compile(r"[^\S\n]{0,3}(?:>+|//+|#+|;+|\*|--)(?=\s|$)[^\S\n]?|[^\S\n]{0,3}>+")
_BULLET = re.compile(r"\s{0,3}(?:[-*+•‣◦▪–]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))\s+(?=\S)")
_LISTING = re.compile(r"(?:\t| {4})\s*\S")
_CLOSERS = r"(?:[\"”’»)\]」』）】》“]|[   ]»|&quot;|\*\*|</[a-z]+>)*"
_NODE = re.compile(
    r"(?P<full>[。！？｡।॥؟;]+)" + _CLOSERS + r"|(?P<dot>[.!?…]+)" + _CLOSERS + r"(?=\s|$|[^\W\d_]|[\"“„«「『(¿¡<*&​])|(?P<semi>;)(?=\s|$)"
)
_PAIRS = re.compile(r"[\"“”„«»「」『』()\[\]（）【】《》]|&quot;")
_OPEN = {"「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "«": "»"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_SKIP = re.compile(r"(?:\s|\*\*|<[a-z]+>|​)*")
_WORD = re.compile(r"[\w.’'@-]+$")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:_+[A-Za-z0-9]|\(\))")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_SPACES = re.compile(r"\s+")
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")

#: How much a span loses that has hardly a letter or digit.
_TOO_SHORT = 4.0


def _pairs(s: str) -> list[tuple[int, int]]:
    """The outermost matched quotations and brackets, as (first character, end); unmatched marks count for nothing."""
    stack: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    found: list[tuple[int, int]] = []

    def push(kind: str, at: int) -> None:
        stack.append((kind, at))
        count[kind] += 1

    def close(kind: str, end: int) -> bool:
        while count[kind]:
            k, at = stack.pop()
            count[k] -= 1
            if k == kind:
                found.append((at, end))
                return True
        return False

    for m in _PAIRS.finditer(s):
        c, at, end = m.group(), m.start(), m.end()
        if c in ('"', "&quot;"):
            before, after = s[at - 1] if at else " ", s[end] if end < len(s) else " "
            if count['"']:
                close('"', end)
            elif not after.isspace() and not before.isalnum():
                push('"', at)
        elif c == "„":
            push("„", at)
        elif c == "“":
            if not close("„", end):
                push("“", at)
        elif c == "”":
            close("“", end) or close("„", end)
        elif c in _OPEN:
            push(c, at)
        else:
            close(_CLOSE[c], end)
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer


def _opens(s: str, at: int) -> tuple[str, str]:
    """How the text goes on: end, capital, open (a quotation or bracket), name (an identifier), digit, small, other script, or mark; and the next word."""
    if at >= len(s):
        return "end", ""
    c = s[at]
    word = s[at : at + 24]
    cut = _SPACES.search(word)
    word = word[: cut.start()] if cut else word
    if c in "\"“„«「『(（【《¿¡[‘" or word.startswith("&quot;"):
        return "open", word
    if c.isdigit():
        return "digit", word
    if c.isalpha():
        if c.isascii() and _NAME.match(word):
            return "name", word
        if c.isupper() or c.istitle():
            return "capital", word
        if c.islower():
            return "small", word
        return "script", word
    return "mark", word


def _score(s: str, m: re.Match, end: int, nxt: int) -> float:
    """How likely a sentence ends with this mark: the closing word and the opening one, jointly."""
    how, word = _opens(s, _SKIP.match(s, nxt).end())
    if how == "end":
        return 9.0
    marks = m.group("dot")
    spaced = nxt > end
    closers = s[m.end("dot") if marks else m.end("full") if m.group("full") else m.end() : end]
    if m.group("full"):
        return 6.0 if not closers or how in ("capital", "open") else 0.5 if how != "mark" else -6.0
    if m.group("semi"):
        near = s[max(0, m.start() - 60) : m.start()]
        greek = len(_GREEK.findall(near))
        return 5.0 if greek > sum(c.isascii() and c.isalpha() for c in near) and how != "small" else -9.0
    if how == "mark":
        return -6.0
    if s[m.start() - 1 : m.start()].isspace() and marks == "." and not spaced:
        return -9.0
    ellipsis = "…" in marks or ".." in marks
    if closers and how in ("small", "script", "name", "digit"):
        return -5.0  # a quotation or bracket that the sentence goes on after; see _span
    if ellipsis:
        if not spaced:
            return -9.0
        return 5.0 if how in ("capital", "open", "name") else 1.0 if how == "digit" else -5.0
    if "!" in marks or "?" in marks:
        if not spaced:
            return 4.0 if how == "capital" or how == "open" and s[nxt] not in "([" else -6.0
        return 4.0 if how != "small" else 2.0
    before = _WORD.search(s, max(0, m.start() - 40), m.start())
    token = before.group().lstrip("'’-@.") if before else ""
    low = token.lower() if token.isascii() else unicodedata.normalize("NFC", token).lower()
    last = token[-1:] if token else s[m.start() - 1 : m.start()]
    if not spaced:
        if how == "script" and last.isalpha():
            return 4.0
        if how != "capital" or len(token) < 2 or not (last.islower() or last.isdigit()) or low in NEVER or "_" in word:
            return -9.0
        return 4.0 if len(word) == 1 or word[1:2].islower() or word[1:2] in "'’" else -9.0
    if low in NEVER or low.rpartition("-")[2] in NEVER and "-" in low:
        return -9.0
    if "." in token and token[token.rindex(".") + 1 :][:1].isupper() and low.rpartition(".")[2] in NEVER:
        return -9.0
    if low in BEFORE_NUMBER and how == "digit":
        return -9.0
    if low in BEFORE_CAPITAL:
        return 4.0 if how in ("capital", "open", "digit") else 1.0 if how == "name" else -9.0
    if len(token) == 1 and token.isalpha():
        if token.isupper() or how == "small" or len(word) == 2 and word[1] == ".":
            return -9.0
        return 2.0
    if re.fullmatch(r"(?:\w\.)+\w", token) and not any(c.isdigit() for c in token) and len(token) <= 5:
        return -2.0 if how in ("capital", "open") else -9.0
    if token.isdigit():
        if how == "small":
            return -9.0
        if len(token) <= 2 and how == "capital":
            previous = s[max(0, m.start() - len(token) - 14) : m.start() - len(token)].split()
            if previous and previous[-1].lower() in ORDINAL_AFTER:
                return -9.0
        return 4.0
    if how == "small":
        return 1.5 if len(token) >= 2 or not token else -3.0
    if how == "script":
        return 4.0
    return 6.0


Node = tuple[int, int, float, int, bool]


def _paragraph(s: str) -> list[tuple[int, int]]:
    """The sentences of a paragraph, whose line breaks and marks are spaces here, as offsets in it."""
    return _best(s, _nodes(s))[1]


def _nodes(s: str) -> list[Node]:
    """Where a sentence could end: end, start of the next one, score, start of the quotation it closes or -1, whether that stands after a colon."""
    n = len(s)
    nodes: list[Node] = []
    pairs = _pairs(s) if _PAIRS.search(s) else []
    k = 0
    for m in _NODE.finditer(s):
        end = m.end()
        while k < len(pairs) and pairs[k][1] < end:
            k += 1
        closes = -1
        if k < len(pairs):
            a, b = pairs[k]
            if a < m.start() < b:
                if end < b and len(s[end:b].strip()) > (6 if s.startswith("&quot;", b - 6) else 1):
                    continue
                end, closes = max(b, end), a
            elif a < end:
                end = a  # a quotation begins here, it does not close
        nxt = end + (len(g.group()) if (g := _SPACES.match(s, end)) else 0)
        score = _score(s, m, end, nxt)
        colon = False
        if closes >= 0:
            lead = s[max(0, closes - 12) : closes].rstrip()
            colon = lead.endswith((":", "："))
        if score > -6.0:
            nodes.append((end, nxt, score, closes, colon))
    if _THAI.search(s):
        nodes += [(g.start(), g.end(), 9.0, -1, False) for g in _THAI_GAP.finditer(s) if not any(a < g.start() < b for a, b in pairs)]
        nodes.sort()
    if not nodes or nodes[-1][1] < n:
        nodes.append((n, n, 9.0, -1, False))
    return nodes


def _best(s: str, nodes: list[Node], every: bool = False) -> tuple[float, list[tuple[int, int]]]:
    """The total score of the best sequence of spans, and the sequence. With `every`, all starts are tried at each node, which gives the same."""
    # best[j]: the best total of spans that end at node j; starts[i] is where a span after node i begins
    starts, best, back = [0], [0.0], [-1]
    lead_at = 0
    for end, nxt, score, closes, colon in nodes:
        top, arg = -1e18, 0
        # A span under four characters begins after one of the last nodes.
        near = range(max(0, len(starts) - 6), len(starts))
        for i in range(len(starts)) if every else {lead_at, *near, *((max(0, bisect_right(starts, closes) - 1),) if closes >= 0 else ())}:
            a = starts[i]
            if a >= end:
                continue
            value = best[i] + score + _span(s, a, end, score, closes, colon, nxt)
            if value > top:
                top, arg = value, i
        starts.append(nxt)
        best.append(top)
        back.append(arg)
        if top >= best[lead_at]:
            lead_at = len(starts) - 1
    out, j = [], len(starts) - 1
    while j > 0:
        i = back[j]
        out.append((starts[i], nodes[j - 1][0]))
        j = i
    out.reverse()
    return best[-1], out


def _span(s: str, a: int, end: int, score: float, closes: int, colon: bool, nxt: int) -> float:
    """What the whole span adds: its length, and how it stands to the quotation or bracket that it closes."""
    value = 0.0
    if end - a < 4 and sum(map(str.isalnum, s[a:end])) < 2 and score < 9:
        value -= _TOO_SHORT
    if closes >= 0 and score <= 0.5:
        how, word = _opens(s, _SKIP.match(s, nxt).end())
        whole = closes <= a + 1
        if s[closes] in "([（【":
            if whole and how != "mark":
                value += 8.0  # a sentence in brackets
        elif how in ("script", "digit") or how == "name" and not s[closes - 2 : closes].isascii():
            if colon and not word.startswith(PARTICLES):
                value += 8.0  # he wrote: "..." and a new sentence in a script without capitals
            else:
                value -= 4.0
    return value


def _spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every sentence of a text."""
    n, at = len(text), 0
    lines: list[tuple[int, int]] = []
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    if at < n:
        lines.append((at, n))
    block: list[tuple[int, int]] = []  # start without mark, end
    starts: list[int] = []
    kind = ""

    def flush() -> Iterator[tuple[int, int]]:
        nonlocal block, starts
        if block:
            yield from _block(text, block, starts)
        block, starts = [], []

    for k, (a, b) in enumerate(lines):
        line = text[a:b]
        if not line or line.isspace():
            yield from flush()
            continue
        if _LISTING.match(line):
            yield from flush()
            yield a + len(line) - len(line.lstrip()), a + len(line.rstrip())
            continue
        mark = _MARK.match(line)
        sign = mark.group().strip() if mark else ""
        if mark and (sign.startswith("*") and not line[0].isspace() or sign == ";" and not _all_marked(text, lines, k)):
            mark, sign = None, ""
        start = a + mark.end() if mark else a
        if block and sign != kind:
            yield from flush()
        kind = sign
        rest = text[start:b]
        if not rest or rest.isspace():
            yield from flush()
            continue
        block.append((start, b))
        starts.append(a)
    yield from flush()


def _all_marked(text: str, lines: list[tuple[int, int]], k: int) -> bool:
    """Whether the lines around line k, up to blank ones, all begin with ';'."""
    for step in (-1, 1):
        j = k + step
        if 0 <= j < len(lines):
            line = text[slice(*lines[j])].strip()
            if line and not line.startswith(";") and not _LISTING.match(text[slice(*lines[j])]):
                return False
    return True


def _block(text: str, block: list[tuple[int, int]], starts: list[int]) -> Iterator[tuple[int, int]]:
    """Sentences of consecutive lines: the items of a list, or those of a paragraph."""
    if _BULLET.match(text[block[0][0] : block[0][1]]):
        first, last = block[0]
        for a, b in block[1:]:
            if _BULLET.match(text[a:b]):
                yield _trim(text, first, last)
                first = a
            last = b
        yield _trim(text, first, last)
        return
    base, end = block[0][0], block[-1][1]
    if len(block) == 1:
        s = text[base:end]
    else:
        parts, at = [], base
        for a, b in block:
            parts.append(" " * (a - at))
            parts.append(text[a:b])
            at = b
        s = "".join(parts)
    lead = len(s) - len(s.lstrip())
    s = s.strip()
    base += lead
    for a, b in _paragraph(s):
        while a < b and s[a].isspace():
            a += 1
        while b > a and s[b - 1].isspace():
            b -= 1
        if a < b:
            yield base + a, base + b


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every sentence of a text, in order."""
    return list(_spans(text)) if text else []


def sentences(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """key, start_char, end_char: one row for each sentence of each text; with_text adds sentence_no and sentence. One pass, no shuffle."""
    names = [key, "start_char", "end_char", *(["sentence_no", "sentence"] if with_text else [])]

    def out(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)] if rows else [()] * (len(names))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                spans = split_sentences(t)
                rows += [(i, a, b, n, t[a:b]) for n, (a, b) in enumerate(spans)] if with_text else [(i, a, b) for a, b in spans]
                if len(rows) > 100_000:
                    yield out(batch, rows)
                    rows = []
            yield out(batch, rows)

    extra = ", sentence_no int, sentence string" if with_text else ""
    return df.select(key, text).mapInArrow(kernel, f"`{key}` {df.schema[key].dataType.simpleString()}, start_char int, end_char int{extra}")
