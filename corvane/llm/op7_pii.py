"""PII by offset-preserving deobfuscation.

Four detectors run over every whole text (the contract's base).  Then transducers rewrite what hides an identifier, each
output character keeping the source stretch that it came from: look-alike letters and wide forms to ASCII, spelled digits
to digits, "(at)" / "[dot]" and plain "at ... dot" to signs.  The same detectors run on the rewritten text around the
rewrites, as far as an identifier's characters go, and a match that holds at least one rewrite is mapped back to source
characters and added, unless it would overlap a span of its kind.  Texts without a trigger aren't rewritten at all.

What counts as a disguise: white space of any kind and length (tabs, line breaks) around a word for a sign and between
digit words, with up to three of the signs ".", "," and "-" among it; a label of a spelled address has up to 63 letters, as
host names do; "at" and "dot" without brackets need a known ending (ENDINGS); digit words count beside digits, "+" and dots,
or four in a row.  Not looked for: signs with white space around them ("jane @ example . com") and character references
("&#64;").

One narrow pass without a shuffle, linear in the text; memory follows a batch of texts.

Edge cases: null text is empty; no spans give an empty list and the digest of an empty string; repeated rows are
scanned one by one; matches that fail a check (octets, Luhn, number of digits) are dropped and not tried again.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match can only start where a run of digits does, and no run is given back in part.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG_ENOUGH = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a local part is the longest run before an at sign that no earlier match has taken."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done:
            low = at
            while True:  # the run's start, looked for in steps so that a long text isn't copied
                step = max(done, low - 64)
                m = _LOCAL_END.search(text[step:low])
                if m is None:
                    break
                low -= len(m.group())
                if low > step:
                    break
            if low < at and (d := _DOMAIN.match(text, at + 1)):
                out.append((low, d.end()))
                done = d.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _DOTTED.search(text):  # else long runs of digits would be tried from each digit on
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
    if _LONG_ENOUGH.search(text):
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


#: Look-alikes of ASCII letters, the digit words of four languages, words for signs.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρνυ", "aeopcyxijsdhlqwABEKMHOPCTXIJSABEZHIKMNOPTYXoapvu", strict=True))
DIGIT_WORDS = {w: str(d) for d, row in enumerate((
    "zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
    "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in row.split()}
#: Endings of a plainly spelled address; without brackets, "at" and "dot" are ordinary words too.
ENDINGS = "com org net edu gov int mil info biz dev app io ai co me tv eu uk us ca au nz ie de at ch fr be nl lu es pt it mx ar br cl pl cz se no dk fi ru jp cn in kr za test example invalid local "
ENDINGS += "shop online xyz site store tech blog cloud club live page work email news space website top pro name jobs museum ro tr hu ua bg hr rs si sk gr ee lv lt is al ba mk md by kz ge am az il ae sa eg ma tn ng ke gh tw hk sg my th vn ph id pk bd lk np cy mt ve uy py bo ec cr do cu eus cat gal asia"
ENDINGS = ENDINGS.split()
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "punto", "point")

_ODD = re.compile("[" + "".join(LOOK_ALIKES) + "！-～٠-٩​‌‍⁠­]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOTS = "|".join(DOT_WORDS)
_GAP = rf"\s++(?:{_DOTS})\s++|\s*+[.,-]{{1,3}}\s*+|\s++"
#: Up to three numbers, then digit words with the digits and signs among and after them; one part or gap of such a stretch.
_SPELLED = re.compile(rf"(?i)(?:(?<![0-9A-Za-z])(?:[0-9]{{1,3}}(?:{_GAP})){{1,3}})?\b(?:{_WORDS})\b(?:(?:{_GAP})(?:(?:{_WORDS})\b|[0-9]{{1,19}}(?![0-9A-Za-z])))*")
_PART = re.compile(rf"(?i)\b(?:{_WORDS})\b|[0-9]+|{_GAP}")
_BRACKET = re.compile(rf"(?i)(?<!\s)\s*+[\[({{<]\s*+(?:({'|'.join(AT_WORDS)}|@)|({_DOTS}|\.))\s*+[\])}}>]\s*+")
_PLAIN = re.compile(rf"(?i)(?<=[a-z0-9._%+-])(\s++(?:at|arroba|arobase)\s++)(?:[a-z0-9-]{{1,63}}(?:\s++(?:{_DOTS})\s++|\.))+(?:{'|'.join(ENDINGS)})\b")
_DOT = re.compile(rf"(?i)(?<!\s)\s++(?:{_DOTS})\s++")
_BETWEEN = re.compile(rf"(?i)(?<=[0-9])\s++(?:{_DOTS})\s++(?=[0-9])")
_AT = re.compile(r"(?i)\s(?:at|arroba|arobase)\s")
#: What an address, and what a number, may hold beside a rewrite.
_BESIDES = tuple((re.compile(rf"{c}+"), re.compile(rf"{c}+\Z")) for c in (r"[A-Za-z0-9._%+@-]", r"[\x20().0-9+-]"))


def _digit(word: str) -> str | None:
    """The digit that a word stands for; letters that only match without regard to case (long s, Turkish i) are folded."""
    return DIGIT_WORDS.get(word.replace("\u017f", "s").replace("\u0130", "i").replace("\u0131", "i").lower())


def _beside(text: str, at: int) -> int | None:
    """Where the gap before a place begins (white space, and up to three of the signs .,-), if a digit or a plus stands before it."""
    signs = 0
    low = at
    while low and (text[low - 1].isspace() or (signs < 3 and text[low - 1] in ".,-")):
        low -= 1
        signs += not text[low].isspace()
    return low if low and (text[low - 1] == "+" or "0" <= text[low - 1] <= "9") else None


def _wide(text: str, a: int, b: int) -> bool:
    """White space that no detector reads over."""
    return text[a:b].isspace() and (text[a:b] != " " or text[a - 1] == "+")


def _is_dot(gap: str) -> bool:
    return gap.strip().lower() in (".", *DOT_WORDS)


def _octets(parts: list[tuple[int, int, str]]) -> list[tuple[int, int, str]] | None:
    """Rewrites of a stretch that is four octets with dots between them, else None."""
    values, out = [""], []
    for a, b, x in parts:
        if x.isdigit():
            values[-1] += x
        elif (word := _digit(x)) is not None:
            values[-1] += word
            out.append((a, b, word))
        elif _is_dot(x):
            values.append("")
            if x != ".":
                out.append((a, b, "."))
        else:
            out.append((a, b, ""))
    return out if len(values) == 4 and all(v and len(v) <= 3 and int(v) <= 255 for v in values) else None


def _digits(text: str, m: re.Match[str]) -> list[tuple[int, int, str]]:
    """Rewrites of one stretch of digit words: dots stay between octets, else the signs between two words go with the first."""
    parts = [(p.start(), p.end(), p.group()) for p in _PART.finditer(text, m.start(), m.end())]
    pieces: list[list[tuple[int, int, str]]] = [[]]
    for p in parts:  # a sentence may end within the stretch
        pieces.append([]) if p[2][0] == "." and p[2][1:].isspace() else pieces[-1].append(p)
    for tried in ([parts], pieces):
        if got := [x for piece in tried for x in _octets(piece) or ()]:
            return got
    out, run = [], []
    for p in [*parts, (m.end(), m.end(), "")]:
        if _digit(p[2]) is not None:
            run.append(p)
        elif run and (p[2] == "" or p[2].isdigit() or p[2].strip().lower() in DOT_WORDS):
            after = p[2].isdigit() or text[run[-1][1] : run[-1][1] + 1].isdigit()
            before = _beside(text, run[0][0])
            if len(run) >= 4 or after or before is not None:
                ends = [*(w[0] for w in run[1:]), run[-1][1]]
                gaps = [(before, run[0][0])] if before is not None else []
                gaps += [(run[-1][1], p[0])] if p[2].isdigit() else []
                out += [(a, b, "") for a, b in gaps if _wide(text, a, b)]
                out += [(w[0], end, _digit(w[2]) or "") for w, end in zip(run, ends, strict=True)]
            run = []
    return out


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """Source stretches (start, end) and what stands for them, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    if not text.isascii():
        for m in _ODD.finditer(text):
            c = m.group()
            o = ord(c)
            found.append((m.start(), m.end(), LOOK_ALIKES.get(c) or (chr(o - 0xFEE0) if 0xFF01 <= o <= 0xFF5E else chr(o - 0x660 + 48) if 0x660 <= o <= 0x669 else "")))
    for m in _SPELLED.finditer(text):
        found += _digits(text, m)
    for m in _BRACKET.finditer(text) if any(c in text for c in "[({<") else ():
        found.append((m.start(), m.end(), "@" if m.group(1) else "."))
    for m in _PLAIN.finditer(text) if any(w in text or w.upper() in text or w.title() in text for w in DOT_WORDS) or _AT.search(text) else ():
        signs = [(m.start(1), m.end(1), "@"), *((d.start(), d.end(), ".") for d in _DOT.finditer(text, m.end(1), m.end()))]
        if len(signs) > 1:
            found += signs
    if any(w in text or w.upper() in text or w.title() in text for w in DOT_WORDS):
        found += [(m.start(), m.end(), ".") for m in _BETWEEN.finditer(text)]
    found.sort()
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _back(text: str, at: int, floor: int) -> int:
    """The first place of the runs of identifier characters that end at a place, not before floor."""
    out = at
    for _, ending in _BESIDES:
        low = at
        while low > floor:  # in steps, so that a long text isn't copied
            step = max(floor, low - 64)
            m = ending.search(text[step:low])
            if m is None:
                break
            low -= len(m.group())
            if low > step:
                break
        out = min(out, low)
    return out


def _stretches(text: str, changes: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """(low, high, rewrites): the rewrites that one match may hold, with the identifier characters around them."""
    low, high, own, ends = 0, 0, [], [0] * len(_BESIDES)
    for x in changes:
        start = _back(text, x[0], high) if x[0] > high or not own else x[0]
        if own and start > high:
            yield low, high, own
            own = []
        if not own:
            low = start
        own.append(x)
        for k, (run, _) in enumerate(_BESIDES):
            if x[1] >= ends[k]:  # else the run that was found before goes on
                m = run.match(text, x[1])
                ends[k] = m.end() if m else x[1]
        high = max(high, *ends)
    if own:
        yield low, high, own


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows."""
    taken = [[s[1:] for s in base if s[0] == k] for k in range(len(KINDS))]
    last, out = [0] * len(KINDS), []
    for low, high, own in _stretches(text, rewrites(text)):
        letters, starts, ends, changed, at = [], [], [], [], low
        for a, b, new in [*own, (high, high, "")]:
            letters.append(text[at:a])
            starts += range(at, a)
            ends += range(at + 1, a + 1)
            changed += [False] * (a - at)
            for c in new:
                letters.append(c)
                starts.append(a)
                ends.append(b)
                changed.append(True)
            at = b
        for kind, a, b in base_spans("".join(letters)):
            span = (kind, starts[a], ends[b - 1])
            if not any(changed[a:b]) and span[2] - span[1] == b - a:
                continue
            k = bisect.bisect_left(taken[kind], span[2], key=lambda s: s[0])  # of the spans that start before this one's end, the last
            if span[1] >= last[kind] and (k == 0 or taken[kind][k - 1][1] <= span[1]):
                out.append(span)
                last[kind] = span[2]
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each sorted by kind and start."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for x in batch.column(1):
                base, full = find(x.as_py())
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(full))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
