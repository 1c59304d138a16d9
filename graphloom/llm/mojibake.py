"""Texts decoded with the wrong character encoding: finding them and restoring what they said.

A text is cut at ASCII white space into stretches, which no encoding in use here would join. For each stretch that looks
odd, a best-first search runs over encode, decode and unescape steps, visited states being hashed; the cost of a state is
how implausible its characters are side by side, so the search follows the cheapest text and ends at the cheapest reachable.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Encodings by which texts are commonly misread, and for each those in which such texts were written.
MISREAD = {
    "cp1252": "utf-8 gbk cp932 euc_jp big5 euc_kr cp1250 iso8859-2 cp1251 koi8-r cp866 mac_roman cp437",
    "latin-1": "utf-8 gbk cp932 euc_jp big5 euc_kr cp1250 iso8859-2 cp1251 koi8-r cp866 mac_roman cp437",
    "iso8859-15": "utf-8",
    "cp1250": "utf-8 cp1252 gbk cp932",
    "iso8859-2": "utf-8 cp1252",
    "cp1254": "utf-8",
    "cp1253": "utf-8",
    "cp1251": "utf-8 koi8-r cp866 cp1252 gbk",
    "koi8-r": "utf-8 cp1251 cp866",
    "cp866": "utf-8 cp1251 koi8-r",
    "mac_cyrillic": "utf-8 cp1251",
    "cp437": "utf-8 cp1252 gbk cp932",
    "cp850": "utf-8 cp1252",
    "mac_roman": "utf-8 cp1252",
    "gbk": "utf-8 cp932 euc_jp big5 euc_kr cp1252 cp1251",
    "cp932": "utf-8 gbk euc_jp cp1252",
    "euc_jp": "utf-8 gbk",
    "big5": "utf-8 gbk cp932",
    "euc_kr": "utf-8 gbk",
}
#: What a step costs, so that a change must earn something.
STEP = 0.5
#: The step that leaves out characters of which nothing but a replacement character is left.
LOST = "lost"
#: What a whole text must become cheaper by to count.
GAIN = 2.5

_MANY = ("utf-8", "gb2312", "gbk", "cp932", "euc_jp", "big5", "euc_kr")


@functools.cache
def _table(name: str) -> dict[int, int]:
    """Character to byte of a one-byte encoding; bytes it leaves undefined stand for themselves, as decoders have it."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = b
    return table


def _encode(text: str, name: str) -> bytes | None:
    if name not in _MANY:
        table = _table(name)
        try:
            return bytes([table[ord(c)] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        return None


#: Classes of characters.
SPACE, ASCII, LOWER, UPPER, CYR_LOWER, CYR_UPPER, CJK, KANA, OTHER, DASH, OPEN, CLOSE, SIGN, BOX, BAD, RARE, MARK, ODD_CYR, HANGUL = range(19)
# Letters with marks that European languages write in running text, and signs.
_LETTERS = set("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœšžąćęłńśźżčďěňřťůőűğışțăș")
_QUOTES_OPEN, _QUOTES_CLOSE = set("„«¿¡‹"), set("”’»›…“‘")
_CYR_RARE = set("фщъэюцхжйшчё")
_CYR = set("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ")


@functools.cache
def kind(c: str) -> tuple[int, float]:
    """Class of a character and what it costs on its own."""
    o = ord(c)
    if o < 128:
        return (SPACE, 0.0) if c == " " else (BAD, 6.0) if o < 32 and c not in "\t\n\r" else (ASCII, 0.0)
    if o < 160 or o == 0xFFFD or 0xE000 <= o < 0xF900 or 0xD800 <= o < 0xE000:
        return BAD, 6.0
    if c in "µμ":
        return SIGN, 0.8
    if c.lower() in _LETTERS or c in "ªº":
        return (LOWER if c.islower() or c in "ßªº" else UPPER), 1.0
    if c.lower() in _CYR:
        return (CYR_LOWER if c.islower() else CYR_UPPER), 1.3 if c.lower() in _CYR_RARE else 1.0
    if 0x400 <= o < 0x530:
        return ODD_CYR, 3.0
    if 0x3041 <= o <= 0x30FF:
        return KANA, 1.2
    if 0x3400 <= o <= 0x9FFF:
        common = False
        for name, low, high in (("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF), ("big5", 0xA4, 0xC6)):
            data = _encode(c, name)
            common = common or data is not None and len(data) == 2 and low <= data[0] <= high
        return (CJK, 2.0 if common else 4.5)  # as much as the two letters that the same bytes could be
    if 0xAC00 <= o <= 0xD7A3:
        return HANGUL, 2.0
    if 0x3000 <= o <= 0x303F or 0xFF01 <= o <= 0xFF5E or o in (0xFFE5,):
        return KANA, 1.0
    if 0xFF61 <= o <= 0xFF9F:
        return RARE, 3.0
    if 0x2500 <= o <= 0x259F:
        return BOX, 1.0
    if c in "–—‐‑−":
        return DASH, 0.8
    if c in _QUOTES_OPEN:
        return OPEN, 0.8
    if c in _QUOTES_CLOSE:
        return CLOSE, 0.8
    if o == 0xA0 or o == 0x202F or o == 0x2009:
        return SIGN, 1.0
    category = unicodedata.category(c)
    if category in ("Cn", "Co", "Cs"):
        return BAD, 6.0
    if category in ("Mn", "Me", "Mc", "Cf"):
        return MARK, 0.6 if category == "Cf" or 0xFE00 <= o <= 0xFE0F else 1.6
    if category[0] == "L":
        return (RARE, 2.5) if o < 0x370 or 0x250 <= o < 0x300 else (OTHER, 1.2)
    return SIGN, 1.5


_LATIN, _CYRILLIC, _CHINESE = (LOWER, UPPER), (CYR_LOWER, CYR_UPPER, ODD_CYR), (CJK, KANA, HANGUL)
_POINTS = (DASH, OPEN, CLOSE)


def _between(a: int, x: str, b: int, y: str) -> float:
    """What two neighbouring characters of classes a and b cost besides themselves."""
    ax, by = a == ASCII and x.isalpha(), b == ASCII and y.isalpha()
    letter_a, letter_b = ax or a in _LATIN, by or b in _LATIN
    extra = 0.0
    if b in (UPPER, CYR_UPPER) and (a in (LOWER, CYR_LOWER) or ax and x.islower()):
        extra += 2.5  # a capital within a word
    if a in _LATIN and b in _LATIN:
        extra += 0.7
    if a == CYR_UPPER and b == CYR_UPPER:
        extra += 0.15
    if a in _CYRILLIC and letter_b or letter_a and b in _CYRILLIC:
        extra += 4.0
    if y in "ъыь" and a not in _CYRILLIC:
        extra += 1.5  # these begin no word
    if a in (CJK, HANGUL) and b in _LATIN or a in _LATIN and b in _CHINESE or a == KANA and b in _LATIN:
        extra += 2.5
    if a in _CHINESE and b in _CYRILLIC or a in _CYRILLIC and b in _CHINESE:
        extra += 2.5
    if a in (RARE, OTHER) and (b in _LATIN or b in _CYRILLIC or b == CJK) or b in (RARE, OTHER) and (a in _LATIN or a in _CYRILLIC or a == CJK):
        extra += 2.0
    if a == OTHER and by or ax and b == OTHER:
        extra += 2.0
    if a == CJK and b == HANGUL or a == HANGUL and b == CJK:
        extra += 1.5
    if a == CJK and by or ax and b == CJK:
        extra += 0.4
    if a == HANGUL and by or ax and b == HANGUL:
        extra += 0.9
    for letter, ascii_, sign, what in ((a, ax, b, y), (b, by, a, x)):
        if sign == SIGN and (letter in _LATIN or letter in _CYRILLIC or ascii_ and what not in "²³°™®©µ±\xa0"):
            extra += 1.5 if ascii_ or what == "\xa0" else 2.5  # a sign beside a letter
        if sign == BOX and (ascii_ or letter in _LATIN or letter in _CYRILLIC or letter in (SIGN, BAD, OTHER)):
            extra += 3.0
        if sign in _POINTS and letter in (SIGN, BAD, RARE) and what not in "…" and (x != " " and y != "\xa0" and x != "\xa0"):
            extra += 2.0
    if a == SIGN and b == SIGN and x != y:
        extra += 1.5
    if b == OPEN and (letter_a or a in _CYRILLIC):
        extra += 2.0  # an opening mark within a word
    if b in _POINTS and a == UPPER:
        extra += 1.5
    if a == CLOSE and (letter_b or b in _CYRILLIC) and x not in "’‘“…":
        extra += 1.5
    return extra


#: Pairs of characters whose cost a worker remembers at most.
REMEMBERED = 500_000
_pairs: dict[tuple[str, str], tuple[float, bool]] = {}


def _pair(x: str, y: str) -> tuple[float, bool]:
    """What y costs after x, and whether that is odd in a rightly decoded text."""
    (a, _), (b, own) = kind(x), kind(y)
    joint = _between(a, x, b, y) if a != SPACE and (a != ASCII or b != ASCII) else 0.0
    if len(_pairs) >= REMEMBERED:
        _pairs.clear()
    _pairs[x, y] = got = (own + joint, own >= 2.5 or joint >= 1.0)
    return got


def cost(text: str) -> float:
    """How implausible the characters of text are; 0 for ASCII."""
    if text.isascii() and text.isprintable():
        return 0.0
    get = _pairs.get
    return sum([(get(p) or _pair(*p))[0] for p in zip(" " + text, text)])


def odd(text: str) -> bool:
    """Whether characters of text stand as they hardly do in a rightly decoded one, or too many that are seldom do."""
    get = _pairs.get
    pairs = [get(p) or _pair(*p) for p in zip(" " + text, text)]
    if any([x for _, x in pairs]):
        return True
    n = sum([c > "\x7f" for c in text])
    return n >= 3 and max(text) < "\u3000" and sum([x for x, _ in pairs]) >= 1.5 * n


_ENTITY = re.compile(r"&(?:#\d{2,5}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8});")


def _steps(text: str) -> Iterator[tuple[str, str, bool]]:
    """Texts one step away, with the step's name, and whether another may follow: a text misread twice was stored as
    UTF-8 between."""
    if _ENTITY.search(text):
        yield html.unescape(text), "unescape", True
    if "�" in text:
        yield text.replace("�", ""), LOST, False
    tried: dict[bytes, str] = {}
    for wrong, written in MISREAD.items():
        data = _encode(text, wrong)
        if data is None or data in tried or data.isascii():
            continue
        tried[data] = wrong
        for right in written.split():
            got = _decode(data, right)
            if got is not None and got != text:
                yield got, f"{wrong}>{right}", right == "utf-8"
            elif right == "utf-8" and len(data) > 6:  # bytes lost or cut at an end: a little may stay unreadable
                got = data.decode("utf-8", "replace")
                if got.count("�") <= max(1, len(got) // 6):
                    yield got, f"{wrong}>utf-8", False


@functools.cache
def _japanese(c: str) -> bool:
    data = _encode(c, "euc_jp")
    return data is not None and len(data) == 2 and data[0] <= 0xCF


def _lone(text: str) -> float:
    """What a found text costs as a whole: a single Chinese, Japanese or Korean character is made by chance rather than
    written, and with kana stand the characters that Japanese uses."""
    if max(text, default="") < "\u3000":
        return 0.0
    extra = 2.0 if sum(kind(c)[0] in _CHINESE for c in text) == 1 else 0.0
    if any("\u3041" <= c <= "\u30ff" for c in text):
        extra += 1.5 * sum("\u3000" < c <= "\u9fff" and not _japanese(c) for c in text)
    return extra


def restore(text: str) -> tuple[str, float, str]:
    """(cheapest reachable text, how much cheaper it is, the steps to it).

    All states that can be reached are visited, the cheapest first, each once. There is an end to them: only decoding as
    UTF-8 and unescaping lead to states that are expanded, and both make the text shorter.
    """
    start = cost(text)
    best = (start, text, "")
    queue = [(start, 0, text, "")]
    visited = {hash(text)}
    while queue:
        _, steps, state, path = heapq.heappop(queue)
        for got, step, more in _steps(state):
            if (key := hash(got)) in visited:
                continue
            visited.add(key)
            priced = cost(got) + STEP * (steps + 1) + (_lone(got) if step != LOST else 0.0)
            way = f"{path} {step}".strip()
            if priced < best[0]:
                best = (priced, got, way)
            if more:
                heapq.heappush(queue, (priced, steps + 1, got, way))
    return best[1], start - best[0], best[2]


_STRETCH = re.compile(r"[^\t\n\r\x0b\x0c ]+")
# Marks that enclose a quotation.
_QUOTES = [('"', '"'), ("'", "'"), ("`", "`"), ("“", "”"), ("„", "“”"), ("«", "»"), ("»", "«"), ("‘", "’"), ("‹", "›"), ("「", "」"), ("『", "』"), ("”", "”")]
_QUOTED = [re.compile(rf"(?<![\w{re.escape(a)}]){re.escape(a)}(?=([^\s{re.escape(a if a == b else '')}][^\n{re.escape(b)}]{{0,39}})(?<!\s)[{re.escape(b)}](?![\w{re.escape(b)}]))") for a, b in _QUOTES]

#: What may be a garbled word beside Chinese or Japanese text without a blank: a run of characters of other scripts.
_RUN = re.compile(r"[^\u1100-\u11ff\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0003ffff]+")
#: Two or more entities one after the other, as garbling leaves them.
_ENTITIES = re.compile(r"(?:&(?:[A-Za-z]\w*|#\d+|#[xX][0-9a-fA-F]+);){2}")

_searched: dict[str, tuple[str, float, str]] = {}


def _bare(stretch: str) -> str:
    """A stretch without entities, if several stand in a row: those cost what they stand for."""
    return html.unescape(stretch) if _ENTITIES.search(stretch) else stretch


def _restored(stretch: str) -> tuple[str, float, str]:
    if (got := _searched.get(stretch)) is None:
        if len(_searched) >= REMEMBERED // 10:
            _searched.clear()
        got = restore(stretch)
        if not got[2] and (bare := _bare(stretch)) != stretch:
            text, gain, path = restore(bare)
            got = (text, gain, f"unescape {path}") if path else got
        _searched[stretch] = got
    return got


def _apply(stretch: str, path: str) -> str | None:
    """The text that the steps of path make of a stretch, if they can be taken."""
    for step in path.split():
        if step in ("unescape", LOST):
            stretch = html.unescape(stretch) if step == "unescape" else stretch.replace("�", "")
            continue
        wrong, right = step.split(">")
        data = _encode(stretch, wrong)
        got = None if data is None else _decode(data, right)
        if got is None:
            return None
        stretch = got
    return stretch


def _stretches(text: str) -> Iterator[tuple[int, int, bool]]:
    """Where stretches with characters beyond ASCII begin and end, and whether each is but a quotation: enclosed in
    quotation marks by itself. Of a quotation only what is between the marks is meant."""
    spans = sorted(m.span(1) for (mark, _), q in zip(_QUOTES, _QUOTED) if mark in text for m in q.finditer(text))
    spans = [(a, b) for a, b in spans if (not text[a:b].isascii() or _ENTITIES.search(text, a, b)) and text.count(" ", a, b) < 3]
    k = 0
    for m in _STRETCH.finditer(text):
        if m.group().isascii() and not _ENTITIES.search(m.group()):
            continue
        start, end = m.span()
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        inside = [s for s in spans[k:] if s[0] < end][:1] if k < len(spans) and spans[k][0] < end else []
        if inside:
            a, b = inside[0]
            if a > start and not text[start:a].isascii():
                yield start, a, False
            yield max(a, start), min(b, end), True
            if b < end and not text[b:end].isascii():
                yield b, end, False
        else:
            yield start, end, False


def _worth(stretch: str) -> bool:
    return odd(_bare(stretch))


def _runs(text: str, start: int, end: int, quoted: bool) -> list[tuple[int, int, bool]]:
    """The stretch itself or, if no step mends it as a whole, those of its runs without Chinese or Japanese characters that
    a step mends. Where characters are lost, what looks like Chinese is garbled too."""
    stretch = text[start:end]
    runs = [m.span() for m in _RUN.finditer(stretch)]
    if quoted or "�" in stretch or not runs or runs == [(0, len(stretch))] or not odd(stretch) or _restored(stretch)[2]:
        return [(start, end, quoted)]
    runs = [(start + a, start + b) for a, b in runs if not stretch[a:b].isascii() and odd(stretch[a:b]) and _restored(stretch[a:b])[2]]
    if not runs:
        return [(start, end, quoted)]
    return [(a, b, False) for a, b in runs]


def analyse(text: str | None) -> tuple[bool, str | None, float, str]:
    """(whether text holds a wrongly decoded stretch, the text restored as far as it can be, by how much it is cheaper,
    the steps). Stretches that are only quoted don't count and are left as they are."""
    if not text or text.isascii() and not _ENTITIES.search(text):
        return False, text, 0.0, ""
    found = [s for whole in _stretches(text) for s in _runs(text, *whole)]
    paths: Counter[str] = Counter()
    lost = False
    for a, b, quoted in found:
        stretch = text[a:b]
        if quoted or not _worth(stretch):
            continue
        _, gain, path = _restored(stretch)
        if path == LOST:  # nothing to be restored: the stretch stays as it is
            lost |= gain >= GAIN
        elif path and gain > 0:
            paths[path] += gain
    total, used, pieces, last = 0.0, set(), [], 0
    ways = [p for p, _ in paths.most_common()]
    lines = {}
    for a, b, quoted in found if ways else []:
        if quoted:
            continue
        stretch = text[a:b]
        before = cost(_bare(stretch))
        options = [(cost(got) + STEP * len(w.split()) / 4 + _lone(got), got, w) for w in ways if (got := _apply(stretch, w)) is not None]
        if _worth(stretch) and (own := _restored(stretch))[1] > 0 and own[2] != LOST:
            options.append((before - own[1], own[0], own[2]))
        priced, got, way = min(options, default=(before, stretch, ""))
        line = text.rfind("\n", 0, a)
        if priced < before or priced <= before + STEP and way and lines.get(line) == way:
            total += max(0.0, before - priced)
            used.add(way)
            lines[line] = way
            pieces += [text[last:a], got]
            last = b
    restored = "".join([*pieces, text[last:]])
    gain = total - STEP * sum(len(w.split()) for w in used)
    if gain < GAIN and not lost:
        return False, text, 0.0, ""
    return True, restored, gain, " | ".join(sorted(used))


def find_garbled(texts: DataFrame) -> DataFrame:
    """Rows of texts (doc_id, text) that hold a stretch decoded with a wrong encoding, once or repeatedly: doc_id,
    restored (the text, mended as far as it can be), fully (nothing odd is left of it), gain and steps.

    Null, empty and ASCII texts have no row, unless garbled text is kept as entities there; neither has a text that only quotes such stretches. Whole texts are
    searched, row by row, so nothing is shuffled.
    """
    dtype = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "restored", "fully", "gain", "steps"]
        for batch in batches:
            keep, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found, restored, gain, steps = analyse(text)
                if found:
                    keep.append(i)
                    fully = LOST not in steps and not any(odd(restored[a:b]) for a, b, quoted in _stretches(restored) if not quoted)
                    rows.append((restored, fully, gain, steps))
            columns = [batch.column("doc_id").take(pa.array(keep, pa.int64()))]
            columns += [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.bool_(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {dtype}, restored string, fully boolean, gain double, steps string")
