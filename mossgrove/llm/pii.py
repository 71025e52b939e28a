"""Personal data in texts, also where it is disguised.

Base patterns look at the text as it is. Then transducers rewrite it: homoglyphs, full-width and other digits
become ASCII and invisible characters go; spelled digits become digits; ``[at]`` and ``dot`` disguises become signs.
Each character of the rewritten text keeps the source span it came from, so what the patterns find there maps
back to source characters. Only what a transducer changed is added, also where it goes beyond
a base span that it holds a part of; masks cover the union.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import map_batches, texts_of, with_text
from mossgrove.llm.spans import Span, beyond, digest, free, joined

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from inside too, so these start where a run does
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain, found from the @ outwards: linear for any text."""
    out, free_from, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free_from and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            free_from = m.end()
        at = text.find("@", max(at + 1, free_from))
    return out


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def base(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and then by start."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _NO_DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return out


# Letters of Cyrillic and Greek that look like Latin ones (fixed values)
_LOOK = "аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοαινρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LIKE = "aeopcyxijsdhlABEKMHOPCTXIJSoaivpukABEZHIKMNOPTYX"
_HOMOGLYPHS = dict(zip(_LOOK, _LIKE)) | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"。": ".", "․": ".", "‧": ".", "﹒": ".", "﹫": "@", "⁺": "+", "﹢": "+"}
_HOMOGLYPHS |= {x: " " for x in "   　"} | {x: "-" for x in "‐‑‒–−"} | {x: "" for x in "​‌‍⁠﻿­"}
_HOMOGLYPHS |= {c: str(unicodedata.digit(c)) for c in map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)])}
_HOMO = re.compile("[" + re.escape("".join(_HOMOGLYPHS)) + "]")

# Spelled digits (fixed values)
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(plus|\+)[ -]*)?((?:{_WORD}|[0-9])(?:[ ,-]{{0,2}}(?:{_WORD}|[0-9])){{4,}})(?!\w)")
_ONE = re.compile(rf"(?i){_WORD}|[0-9]")
# two units next to each other, one of them a word, are in whatever _digits() changes
_AFTER, _BEFORE = re.compile(rf"[ ,-]{{0,2}}(?:{_WORD}|[0-9])"), re.compile(r"[0-9][ ,-]{0,2}\Z")
_WORDS_AT = ahocorasick.Automaton()
for _w in _DIGITS:
    _WORDS_AT.add_word(_w, len(_w))
_WORDS_AT.make_automaton()
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|\.)"
_ADDRESS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,3}}?)({_AT})([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{1,4}})(?![A-Za-z0-9-]|\s+at\s|\s*@)")
_HINTS = ("@ ", " @", *(f"{b}{s}{w}" for b in "[({<" for s in ("", " ") for w in ("at", "dot", "punkt", "punto", "point", "@", ".")), *(f" {w} " for w in ("dot", "punkt", "punto", "point")))
# Endings of hosts that a bare "at ... dot ..." needs, so that prose isn't an address (fixed values): of countries, and common others
_ENDINGS = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "com org net edu gov mil int info biz name pro aero arpa asia cat coop jobs mobi museum post tel travel xxx app dev example test invalid local online site tech store shop blog cloud email mail agency academy art bank berlin bio cafe care center chat city club company consulting design digital diy earth energy engineering events expert family farm finance foundation fun fund games global group guru health help host hosting house icu inc ink institute international jetzt koeln law legal life link live llc london ltd marketing media moe money network news ngo nyc one ong onl page paris partners photo photography plus press pub quest report rocks run sale school science security services social software solutions space studio style support systems team tips today tokyo tools top training university ventures video vip website wien wiki win work works world wtf xyz zone".split()
)
# Endings that are words of prose too, and what no host before such an ending is called: "at this point it", "at the dot in"
_WORDS = frozenset("am as at be by do es id in is it la me my no so st to us one plus post name pro art care center city company family group health help house law life link live local mail media money news page press run sale school science security services site space store style support systems team test tips today tools top training work works world".split())
_NO_HOST = frozenset("a an the this that these those some any no one each every which what whatever certain another same either single starting turning boiling freezing der die das dem den diesem einem el la los las le les un una une este ese cet ce quel".split())
# Without brackets or spelled dots, "jane at gmail.com" is an address if the host gives mailboxes to anyone, if the name
# looks like a login or if mail is spoken of right before; "look at example.com" is none (fixed values)
_MAILBOXES = re.compile(r"(?i)(?:gmail|googlemail|yahoo|ymail|hotmail|outlook|live|msn|aol|icloud|gmx|web|t-online|freenet|posteo|mailbox|orange|wanadoo|laposte|sfr|libero|virgilio|yandex|mail|rambler|qq|163|126|naver|daum|hanmail|proton|protonmail|pm|zoho|fastmail|tutanota|tuta|hey|terra|uol|bol|telefonica|comcast|verizon|att|sbcglobal|btinternet|rediffmail|rocketmail|inbox|mac|me)(?:\.[a-z]{2,3}){1,2}")
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9_%+-]*[0-9._+-][A-Za-z0-9._%+-]*")
_CUE = re.compile(r"(?i)(?:e-?mail|mail|write|contact|reach|schreib\w*|escrib\w*|correo|courriel|contacte\w*|écri\w*|kontakt)(?:\s+(?:to|me|us|an|a|à|is|address|ist|es|est))*\s*:?\s*\Z")
_PROSE = frozenset("look looks looked looking us me him her them it is are was were be available live hosted found read more see visit page site team here there online located meet account accounts address mail email e-mail write contact reach work works working log login sign register registered free today now shop find out only also directly and or".split())
_PLAIN_AT = re.compile(r"(?i)\sat\s+[a-z0-9-]+\.[a-z0-9-]")
_DOTTED = re.compile(rf"(?i){_DOT}")
_NUMBERS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")


class Mapped:
    """A text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> None:
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new, (s, e) = by(m), m.span()
            if new == m[0]:
                continue
            parts += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def span(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def _digits(m: re.Match) -> str:
    words = [x[0].lower() for x in _ONE.finditer(m[2])]
    return ("+" if m[1] else "") + "".join(_DIGITS.get(x, x) for x in words) if any(x in _DIGITS for x in words) else m[0]


def _address(m: re.Match) -> str:
    """An address whose @ is a sign or in brackets, or is a bare word: before a host that is spelled out, or as _login() says."""
    name, host = _DOTTED.sub(".", m[1]), _DOTTED.sub(".", m[3])
    if "@" in m[2] or re.search(r"[\[({<]", m[2]) or (_spelled(m[3], host) if host != m[3] else _login(m, name, host)):
        return f"{name}@{host}"
    return m[0]


def _spelled(written: str, host: str) -> bool:
    """Whether a host with spelled dots has a known ending and is none of prose's "at this point in"."""
    *labels, ending = host.lower().split(".")
    if ending not in _ENDINGS:
        return False
    return ending not in _WORDS or not (labels[-1] in _NO_HOST or (ending not in ("it", "at", "us", "es") and re.search(r"(?i)\spoint\s", written)))


def _login(m: re.Match, name: str, host: str) -> bool:
    if host.rpartition(".")[2].lower() not in _ENDINGS or name.lower() in _PROSE:
        return False
    return bool(_MAILBOXES.fullmatch(host) or _LOGIN.fullmatch(name) or _CUE.search(m.string, max(0, m.start() - 40), m.start()))


def _lower(text: str) -> str:
    """In lower case, where the letters that (?i) also takes for i and s are those."""
    return (text if text.isascii() else text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")).lower()


def _paired(low: str) -> bool:
    """Whether a spelled digit has another digit, spelled or not, next to it. Each spelled digit is looked at once."""
    return any(_AFTER.match(low, last + 1) or _BEFORE.search(low, max(0, last - n - 2), last - n + 1) for last, n in _WORDS_AT.iter(low))


def _marks(text: str) -> tuple[bool, bool]:
    """Whether a text has runs of digits some of which are spelled, and may have disguised signs."""
    low = _lower(text)
    return _paired(low) and any(_digits(m) != m[0] for m in _SPELLED.finditer(text)), any(x in low for x in _HINTS) or bool(_PLAIN_AT.search(low))


def disguised(text: str, found: list[Span]) -> list[Span]:
    """Spans, in ``text``, of what only its rewritten form shows."""
    looks, (spelled, signs) = not text.isascii() and _HOMO.search(text), _marks(text)
    if not (looks or spelled or signs):
        return []
    t = Mapped(text)
    if looks:
        t.rewrite(_HOMO, lambda m: _HOMOGLYPHS[m[0]])
        spelled, signs = _marks(t.text)
    if spelled:
        t.rewrite(_SPELLED, _digits)
    if signs:
        t.rewrite(_ADDRESS, _address)
        t.rewrite(_NUMBERS, lambda m: _DOTTED.sub(".", m[0]))
    if t.text == text:
        return []
    spans = [(k, *t.span(s, e), t.text[s:e]) for k, s, e in base(t.text)]
    more = free([(k, s, e) for k, s, e, x in spans if text[s:e] != x], [])
    return beyond(more, found)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, by kind and then by start."""
    found = base(text)
    more = disguised(text, found)
    return found, sorted(found + more, key=lambda x: (KINDS.index(x[0]), x[1])) if more else found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of ``docs`` (doc_id, text).

    The counts and the digest are of the base spans. A null text is empty and has no spans. Null and repeated
    ids are scanned row by row; very long texts are scanned whole, in time in proportion; other columns are ignored; an empty
    table gives no rows.
    """

    def make():
        def work(batch):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for text in texts_of(batch["text"]):
                found, every = scan(text)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in found))
                out["base_sha256"].append(digest(found))
                out["spans"].append(joined(every))
            return out | {"doc_id": batch["doc_id"]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans the earlier, longer one counts."""
    out, at = [], 0
    for kind, s, e in sorted(scan(text)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        elif e > at:
            out += [] if out else [f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced. Null texts stay null; other columns stay as they are."""

    def change():
        return lambda column: (pa.array([x if x is None else masked(x) for x in column.to_pylist()], column.type), None)

    return with_text(docs, text, change)
