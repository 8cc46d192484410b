"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, schemes and
identifier cues); deterministic local parsers expand each anchor to its span and
validate it. A parser either goes on where the one before it ended or looks at a
bounded number of characters, so cost is linear in a text's length.

Base kinds, leftmost and not overlapping within a kind: email, ip, card, phone.
The method adds: url (scheme anchors), account, iban and secret (identifier cues).
Between a cue and its number may stand a few separators and words such as "number".

Defined results: a null or empty text has no spans; repeated rows give repeated
results; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "iban", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn", "customer id", "user id")
IBAN_CUES = ("iban",)
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key")
#: Words that may stand between a cue and what it announces, and how many of them.
FILLERS, MOST_FILLERS = frozenset(("number", "no", "nr", "num", "id", "is", "code", "value")), 2
#: Longest account number and secret.
ACCOUNT_CHARS, SECRET_CHARS = 34, 256

DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = _ALNUM | frozenset("._%+-")
LABEL = _ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_STOP = frozenset(" \t\n\x0b\x0c\r\"<>")
URL_TAIL = frozenset(".,;:!?)]}'")
SEPARATORS, ASSIGNED, SECRET = frozenset(" :#=.\t-"), frozenset("\"'`"), _ALNUM | frozenset("_./+=~-")

Span = tuple[str, int, int]


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [*((d, "digit") for d in DIGITS), ("@", "at"), ("+", "plus"), *((s, "scheme") for s in SCHEMES), *((s, "account") for s in ACCOUNT_CUES), *((s, "iban") for s in IBAN_CUES), *((s, "secret") for s in SECRET_CUES)]:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset, most: int | None = None) -> int:
    """End of the run of allowed characters that starts at ``at``, of which at most ``most`` are read."""
    n = len(text) if most is None else min(len(text), at + most)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """Span around the at-sign; characters before ``free`` belong to an earlier match."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def _ip(text: str, start: int) -> tuple[int, int, bool]:
    """From a digit: end of the four dotted parts and whether they are valid; or where to go on."""
    end = first = _run(text, start, DIGITS)
    parts = [text[start:end]]
    while len(parts) < 4 and end < len(text) and text[end] == "." and (after := _run(text, end + 1, DIGITS)) > end + 1:
        parts.append(text[end + 1 : after])
        end = after
    if len(parts) < 4:
        return first, first, False
    return start, end, all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts)


def _card(text: str, start: int) -> tuple[int, bool]:
    """From a digit: end of the chain of digits with single separators, and whether it is a card."""
    n, end = len(text), start + 1
    digits = [text[start]]
    while end < n:
        at = end + (text[end] in " -")
        if at >= n or text[at] not in DIGITS:
            break
        digits.append(text[at])
        end = at + 1
    return end, 14 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, plus: int) -> tuple[int, bool] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:  # a digit, at least one character, a digit
        return None
    return end, 10 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def _url(text: str, start: int, body: int) -> int | None:
    end = body
    while end < len(text) and text[end] not in URL_STOP:
        end += 1
    while end > body and text[end - 1] in URL_TAIL:
        end -= 1
    return end if end > body else None


def _after_cue(text: str, at: int, separators: frozenset = SEPARATORS) -> int:
    """Past the few separators and words between a cue and what it announces."""
    for _ in range(MOST_FILLERS + 1):
        at = _run(text, at, separators, 8)
        end = _run(text, at, _ALNUM, 8)
        if text[at:end].lower() not in FILLERS:
            break
        at = end
    return at


def _account(text: str, at: int) -> tuple[int, int] | None:
    start = _after_cue(text, at)
    end = _run(text, start, _ALNUM | {"-"}, ACCOUNT_CHARS + 1)
    if end - start > ACCOUNT_CHARS:
        return None
    while end > start and text[end - 1] == "-":
        end -= 1
    return (start, end) if end - start >= 6 and sum(c in DIGITS for c in text[start:end]) >= 5 else None


def _secret(text: str, at: int) -> tuple[int, int] | None:
    """A value of letters and digits that is assigned to the cue."""
    start = _after_cue(text, at, SEPARATORS | ASSIGNED)
    end = _run(text, start, SECRET, SECRET_CHARS + 1)
    value = text[start:end]
    good = 8 <= end - start <= SECRET_CHARS and any(c in DIGITS for c in value) and any(c in "=:" for c in text[at:start])
    return (start, end) if good else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    start = _after_cue(text, at)
    end, kept = start, []
    while end < len(text) and len(kept) < 34:
        c = text[end]
        if c in _ALNUM:
            kept.append(c.upper())
            end += 1
        elif c == " " and end + 1 < len(text) and text[end + 1] in _ALNUM and kept:
            end += 1
        else:
            break
        if len(kept) == 4 and not (kept[0].isalpha() and kept[1].isalpha() and kept[2] in DIGITS and kept[3] in DIGITS):
            return None
        if len(kept) >= 15 and (end == len(text) or text[end] not in _ALNUM):
            moved = "".join(kept[4:] + kept[:4])
            if int("".join(str(int(x, 36)) for x in moved)) % 97 == 1:
                return start, end
    return None


_CUED = {"account": _account, "iban": _iban, "secret": _secret}


def find_spans(text: str | None) -> list[Span]:
    """All spans, by start, then kind as listed in KINDS."""
    if not text:
        return []
    out: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where the search of each kind goes on
    for last, (anchor, length) in _automaton().iter(text):
        start = last - length + 1
        if anchor == "digit":
            if start >= free["ip"]:
                s, e, good = _ip(text, start)
                free["ip"] = e
                if good:
                    out.append(("ip", s, e))
            if start >= free["card"]:
                e, good = _card(text, start)
                free["card"] = e
                if good:
                    out.append(("card", start, e))
        elif anchor == "at":
            if start >= free["email"] and (found := _email(text, start, free["email"])):
                out.append(("email", *found))
                free["email"] = found[1]
        elif anchor == "plus":
            if start >= free["phone"] and (got := _phone(text, start)):
                free["phone"] = got[0]
                if got[1]:
                    out.append(("phone", start, got[0]))
        elif anchor == "scheme":
            if start >= free["url"] and (end := _url(text, start, last + 1)):
                out.append(("url", start, end))
                free["url"] = end
        else:
            found = _CUED[anchor](text, last + 1)
            if found and found[0] >= free[anchor]:
                out.append((anchor, *found))
                free[anchor] = found[1]
    return sorted(out, key=lambda x: (x[1], _RANK[x[0]], x[2]))


def redact(text: str | None) -> str | None:
    """Each span replaced by its kind in brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long, n_spans long"


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                spans = find_spans(x.as_py())
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            cells = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=names)

    names = [x.split()[0] for x in FOUND.split(", ")]
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with the spans of ``text_col`` replaced by their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i).name, pa.array([redact(x.as_py()) for x in b.column(i)], pa.string()))

    return df.mapInArrow(run, df.schema)
