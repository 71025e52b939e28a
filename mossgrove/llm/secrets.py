"""Secret scans: fixed patterns and sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more characters of keys and encodings. A window moves over it; the counts of
the characters in it, and the sum of ``c * log2(c)`` over them, are kept up to date as one character enters and one
leaves, so a step costs the same for any window. Where the entropy reaches the threshold of the window's
character class the window is a secret; such windows that touch are one span. Windows that touch what the
allow-list knows (identifiers, digests named as such, placeholders) are left out.
"""

from __future__ import annotations

import re
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import map_batches, texts_of
from mossgrove.llm.spans import Span, digest, joined, outside

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f]+ fails if it has fewer
NAMES = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character, by class of the window's characters. Digits alone are never a secret, nor are letters of one case.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "upper": 3.5, "letters": 3.9, "alnum": 3.65, "base64": 3.75}
#: A window that touches one of these isn't a secret: identifiers, digests named as such, placeholders.
ALLOWED = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"
    r"|(?i:(?<![a-z])(?:md5|sha1|sha256|sha512)[-_=][a-z0-9+/=]*|example|sample|placeholder|dummy|changeme|xxxx|1234567890)"
)
#: Parts of names: a window of both cases of which so large a share lies in them is a path or a name in CamelCase.
NAME_PART = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]{1,4}|[0-9]{1,4})(?![A-Za-z0-9])|[A-Z]?[a-z]{3,}")
NAME_SHARE = (3, 5)
_C = [0.0] + [c * log2(c) for c in range(1, 257)]


def base(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then by kind."""
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _class(lower: int, upper: int, digit: int, hexa: int, size: int) -> str | None:
    """From the counts in a window of lower-case, upper-case, digit and hexadecimal characters.

    Letters without a digit need both cases in fair shares, so that CamelCase isn't one; keys of one case need digits
    among a fifth of their characters, so that names with a number at their end aren't.
    """
    if digit == size:
        return None
    if not digit:
        return "letters" if lower + upper == size and 3 * min(lower, upper) >= size else None
    if hexa == size and not (upper and lower):
        return "hex"
    if lower + upper + digit == size:
        return "alnum" if lower and upper else ("lower" if lower else "upper") if 5 * digit >= size else None
    return "base64" if lower and upper else None


def entropy_spans(run: str, at: int = 0, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[Span]:
    """Spans of windows of a candidate whose entropy reaches their class's threshold; touching ones are joined.

    Windows that touch what is allowed, and those of both cases made up of parts of names, don't count; the rest of the
    candidate is judged as ever.
    """
    counts: dict[str, int] = {}
    weight, kinds = 0.0, [0, 0, 0, 0]  # lower, upper, digit, hexadecimal
    out: list[Span] = []
    allowed = [m.span() for m in ALLOWED.finditer(run)] + [(len(run), len(run))]
    next_ = 0
    named = [0] * (len(run) + 1)
    for m in NAME_PART.finditer(run):
        named[m.start() + 1 : m.end() + 1] = [1] * len(m[0])
    for i in range(len(run)):
        named[i + 1] += named[i]

    def move(c: str, by: int) -> None:
        nonlocal weight
        n = counts.get(c, 0)
        counts[c] = n + by
        weight += _C[n + by] - _C[n]
        for k, has in enumerate((c.islower(), c.isupper(), c.isdigit(), c in "0123456789abcdefABCDEF")):
            kinds[k] += by * has

    size = min(window, len(run))
    for i, c in enumerate(run):
        move(c, 1)
        if i >= size:
            move(run[i - size], -1)
        begin = i - size + 1
        while allowed[next_][1] <= begin and next_ < len(allowed) - 1:
            next_ += 1
        if begin >= 0 and not (allowed[next_][0] <= i and allowed[next_][1] > begin) and (k := _class(*kinds, size)) and not (kinds[0] and kinds[1] and NAME_SHARE[1] * (named[i + 1] - named[begin]) >= NAME_SHARE[0] * size) and log2(size) - weight / size >= thresholds[k] - 1e-9:
            s, e = at + begin, at + i + 1
            if out and out[-1][2] >= s:
                out[-1] = ("entropy", out[-1][1], e)
            else:
                out.append(("entropy", s, e))
    return out


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, by start and then by kind."""
    if not any(len(w) >= WINDOW for w in text.split()):  # neither a long run nor a candidate
        low = text.lower()
        found = base(text) if any(x in low for x in NAMES) or "AKIA" in text else []
        return found, found
    found = base(text)
    more = [s for m in CANDIDATE.finditer(text) for s in entropy_spans(m[0], m.start())]
    left = [s for s in outside(more, found) if any(c.isalnum() for c in text[s[1] : s[2]])]
    return found, sorted(found + left, key=lambda x: (x[1], KINDS.index(x[0])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs`` (doc_id, text).

    A null text is empty and has no spans. Base spans of different kinds may overlap; of a span that the method adds
    what lies outside them is kept, in pieces if need be. Very long texts are scanned whole, in time in proportion. Null
    and repeated ids are scanned row by row; an empty table gives no rows; other columns are ignored.
    """

    def make():
        def work(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in texts_of(batch["text"]):
                found, every = scan(text)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[0] == k for s in found))
                out["base_sha256"].append(digest(found))
                out["spans"].append(joined(every))
            return out | {"doc_id": batch["doc_id"]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
