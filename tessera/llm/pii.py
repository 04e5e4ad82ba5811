"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus
signs and identifier cues; numbers are anchored where a run of digits starts.  A local parser then expands each anchor to
the left and right and validates what it found; nothing else of the text is
parsed.  Kinds do not exclude each other.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
#: Found beside the base kinds: values after an identifier cue, and URLs that carry a name or password.
KINDS = (*BASE_KINDS, "account", "url")
#: Cues that announce an identifier.
CUES = ("iban", "account", "acct", "passport", "ssn", "token", "secret", "password", "api_key", "apikey")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Of these, values may hold dots, slashes and the signs of base64; of the others, they may be grouped.
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey")
_SIGN = re.compile(r"""(?:[ \t]*(?:no\.?|number|id))?[ \t]*[:=#][ \t]*["']?""", re.IGNORECASE)
_BLANK = re.compile(r"""(?:[ \t]*(?:no\.?|number|id))?[ \t]+["']?""", re.IGNORECASE)
_SECRET = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./+=~-]{5,}")
_ACCOUNT = re.compile(r"[0-9]{2,6}(?:[ ./-][0-9]{2,6})+(?![A-Za-z0-9_-])|[A-Za-z0-9][A-Za-z0-9_-]{5,}")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
#: Lengths of IBANs by country.
_IBAN_LENGTH = {
    c: int(n) for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
    ).split()) for c in countries.split(",")
}
_AUTHORITY = re.compile(r"""[^\s"'<>/@]+@[^\s"'<>@]+""")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


_SMALL = {c: c + 32 for c in range(65, 91)}


@functools.cache
def _anchors():
    """Anchors of a text in small letters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for cue in CUES:
        found.add_word(cue, "cue")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str, ats: Iterable[int]) -> list[tuple[int, int]]:
    out, free = [], 0  # free: end of the last match
    for at in ats:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, free := m.end()))
    return out


def ips(text: str, digits: Iterable[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in digits:
        if at < free:
            continue
        if m := _IP.match(text, at):
            free = m.end()
            if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m.groups()):
                out.append(m.span())
        else:
            free = _DIGITS.match(text, at).end()
    return out


def cards(text: str, digits: Iterable[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in digits:
        if at >= free and (m := _CARD.match(text, at)):
            free = m.end()
            number = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(number) <= 19 and luhn(number):
                out.append(m.span())
    return out


def phones(text: str, pluses: Iterable[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in pluses:
        if at >= free and (m := _PHONE.match(text, at)):
            free = m.end()
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(m.span())
    return out


def iban_end(text: str, start: int) -> int:
    """End of the valid IBAN (ISO 7064, 97-10) that starts here, compact or in groups; 0 if there is none."""
    if not (m := _IBAN.match(text, start)):
        return 0
    length = _IBAN_LENGTH.get(text[start : start + 2].upper())
    ends, code = [], ""
    for at in range(start, m.end()):
        if text[at] not in " -":
            code += text[at].upper()
            if (len(code) == length if length else len(code) >= 15) and not text[at + 1 : at + 2].isalnum():
                ends.append((at + 1, code))
    for end, code in reversed(ends):
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
    return 0


def _account_end(text: str, start: int, cue: str, digits: int) -> int:
    """End of the value of a cue that starts here; 0 if there is none of so many digits."""
    if cue.endswith(SECRET_CUES):
        m = _SECRET.match(text, start)
        value = m[0].rstrip("./") if m else ""
    elif end := iban_end(text, start):
        return end
    elif cue.endswith("iban"):
        return 0
    else:
        m = _ACCOUNT.match(text, start)
        value = m[0] if m else ""
    return start + len(value) if len(value) >= 6 and len(_NOT_DIGIT.sub("", value)) >= digits else 0


def accounts(text: str, ends: Iterable[int]) -> list[tuple[int, int]]:
    """Whole values after a cue.

    After ``:``, ``=`` or ``#``: at least six characters, four of them digits.
    After a blank only: valid IBANs, and values of accounts that start with a
    digit and have eight.  After ``iban``, valid IBANs only.
    """
    out, free = [], 0
    for end in ends:
        cue = text[max(0, end - 7) : end + 1].lower()
        if m := _SIGN.match(text, end + 1):
            stop = _account_end(text, m.end(), cue, 4)
        elif not cue.endswith(SECRET_CUES) and (m := _BLANK.match(text, end + 1)):
            stop = _account_end(text, m.end(), cue, 8) if text[m.end() : m.end() + 1].isdecimal() else iban_end(text, m.end())
        else:
            continue
        if stop and m.end() >= free:
            out.append((m.end(), stop))
            free = stop
    return out


def urls(text: str, ends: Iterable[int]) -> list[tuple[int, int]]:
    """URLs whose authority holds a user name: scheme to the end of the address."""
    out, free = [], 0
    for end in ends:
        start = end - 2
        while start > free and text[start - 1] in _SCHEME:
            start -= 1
        if start < end - 2 and (m := _AUTHORITY.match(text, end + 1)):
            out.append((start, free := m.end()))
    return out


_PARSERS: tuple[tuple[str, str, Callable], ...] = (
    ("email", "at", emails),
    ("ip", "digit", ips),
    ("card", "digit", cards),
    ("phone", "plus", phones),
    ("account", "cue", accounts),
    ("url", "scheme", urls),
)


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end, in code points, of all personal data by kind."""
    at: dict[str, list[int]] = {}
    small = text.lower()
    if len(small) != len(text):  # some letters become two
        small = text.translate(_SMALL)
    for end, kind in _anchors().iter(small):
        at.setdefault(kind, []).append(end)
    if digits := [m.start() for m in _DIGITS.finditer(text)]:
        at["digit"] = digits
    return {kind: parse(text, at[anchor]) for kind, anchor, parse in _PARSERS if anchor in at}


def _written(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found.get(kind, ()))


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every document.

    Null and empty texts have none; repeated rows are searched each; columns
    other than doc_id and text are not read; an empty table gives no rows.
    """

    def go(batches):
        for batch in runs(batches):
            rows = [spans(t) for t in batch.column("text").to_pylist()]
            base = [_written(r, BASE_KINDS) for r in rows]
            counts = [pa.array([len(r.get(k, ())) for r in rows], pa.int64()) for k in BASE_KINDS]
            sha = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([_written(r, KINDS) for r in rows], pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return base.mapInArrow(go, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets.

    Overlapping spans become one, named after the one that starts first (of
    those, the kind listed first).
    """
    found = sorted((a, KINDS.index(kind), b) for kind, all_of in spans(text).items() for a, b in all_of)
    if not found:
        return text
    out, at, k = [], 0, 0
    while k < len(found):
        start, kind, end = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, if there, follows.

    Rows, their other columns, whatever their names, and null texts stay as they
    are; repeated rows are redacted each; an empty table gives no rows.
    """

    def go(batches):
        for batch in runs(batches):
            texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                old = batch.column("n_chars")
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(go, docs.schema)
