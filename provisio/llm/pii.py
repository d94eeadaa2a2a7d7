"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, scheme separators, digits' cues and words that name an
identifier. From each anchor a deterministic local parser grows left and right and validates what it
has. The base kinds (email, ip, card, phone) follow the contract's expressions; parsing from anchors
gives the same leftmost, non-overlapping matches, as every match holds its anchor (ip and card are anchored at runs
of digits, which one scan finds).

The method adds two kinds. address is scheme://authority, where a user part, a dotted name or an IPv4
address stands (a name without a dot, an IPv6 address or four numbers of which one is over 255 gives none); punctuation and brackets that close the sentence around it are left outside, a port counts up to
65535. account is the value behind an identifier cue, taken by the cue's own parser: an IBAN (with or without spaces) whose
check digits hold, a social security number of allowed groups, a passport or account number of 6 to 20 characters and
5 digits at least, a login of letters and digits behind a sign of assignment, a key or token with
letters and digits of 8 characters at least behind one, or of 20 without. Cues are met in any case and are whole words; dates
are no values.

Defined results: null and empty texts have no spans. Offsets count code points, ends are exclusive. Ties
in start sort by end. Repeated rows repeat, very long texts are read whole and in time that follows their length, whatever they hold, an empty table gives an empty result.
Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provisio.llm.common import bounded_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
# Cues by the parser of what follows them.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security number", "social security"),
    "number": ("account", "acct", "passport", "konto", "kontonummer", "compte", "cuenta", "policy number"),
    "login": ("user id", "userid", "user_id", "username", "login"),
    "key": ("token", "api_key", "apikey", "api key", "api-key", "access key", "secret", "secret key", "password", "passwd", "bearer"),
}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:@\[\]-]+")
GAP = re.compile(r"""[^\w\n]{0,10}(?:(?:is|of|no|nr|number|nummer)\b[^\w\n]{0,4}){0,2}""", re.I)
ASSIGNED = re.compile(r"[:=#]|\b(?:is|no|nr|number)\b", re.I)
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([-\x20]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
NUMBER = re.compile(r"[A-Za-z]{0,4}[0-9](?:-?[A-Za-z0-9]){4,20}(?![A-Za-z0-9])")
WORD = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_.+/-]*[A-Za-z0-9_+/=-])?(?![A-Za-z0-9])")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")
LETTER = re.compile(r"[A-Za-z]")
HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]\.?\Z|(?P<quad>[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\Z")
NOT_DIGIT = re.compile(r"[^0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, each with its kind and length."""
    found = ahocorasick.Automaton()
    cues = [(kind, words) for kind, words in CUES.items()]
    for kind, words in (("@", ("@",)), ("+", ("+",)), ("s", ("://",)), *cues):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(UPPER)


UPPER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL_CHARS:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return m and (start, m.end())


def _digits(text: str) -> Iterator[tuple[str, int, int]]:
    """ip and card spans: both are anchored at digits, of which one scan finds the runs."""
    ip = card = 0
    for run in DIGITS.finditer(text):
        at = run.start()
        if at >= ip and text[run.end() : run.end() + 1] == "." and (m := IP.match(text, at)):
            ip = m.end()
            if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m.group().split("."))):
                yield "ip", at, ip
        if at >= card and (m := CARD.match(text, at)):
            card = m.end()
            if 16 <= len(own := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(own):
                yield "card", at, card


def _at_most(digits: str, most: int) -> bool:
    """Whether a decimal number of any length is at most most."""
    return int(digits.lstrip("0")[: len(str(most)) + 1] or "0") <= most


def _host(host: str) -> bool:
    """A dotted name, or four numbers up to 255."""
    m = HOST.match(host)
    return bool(m) and (not m.group("quad") or all(_at_most(p, 255) for p in host.split(".")))


def _closed(own: str) -> str:
    """own without the punctuation and the closing brackets that belong to the sentence around it."""
    end, over = len(own), {")": own.count(")") - own.count("("), "]": own.count("]") - own.count("[")}
    while end and (own[end - 1] in ".,;:!?'*&" or over.get(own[end - 1], 0) > 0):
        if own[end - 1] in over:
            over[own[end - 1]] -= 1
        end -= 1
    return own[:end]


def _address(text: str, at: int, after: int, floor: int) -> tuple[int, int] | None:
    """at: where the colon of :// stands, after: where the authority starts."""
    scheme, found = SCHEME.search(text[max(floor, at - 16) : at]), AUTHORITY.match(text, after)
    if not scheme or not found:
        return None
    own = _closed(found.group())
    user, _, place = own.rpartition("@")
    host, colon, port = place.partition(":")
    if colon and not (port.isascii() and port.isdigit() and _at_most(port, 65535)):
        if user or not _host(host):
            return None
        own = host  # what stands behind the colon is no port
    return (at - len(scheme.group()), after + len(own)) if _host(host) or (user and host) else None


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _account(text: str, kind: str, after: int, barren: list[int]) -> tuple[int, int] | None:
    """The value behind a cue that ends at after. barren: from where to where a run is known to have no digit, so that cues within one run don't read it again."""
    if text[after : after + 1].isalnum() or text[after : after + 1] == "_":
        return None
    gap = GAP.match(text, after)
    at, assigned = gap.end(), bool(ASSIGNED.search(gap.group()))
    if kind == "iban":
        m = IBAN.match(text, at)
        end = m.end() if m else at
        while m and end - at >= 15:
            if text[end - 1] != " " and not text[end : end + 1].isalnum() and iban_ok(text[at:end]):
                return at, end
            end -= 1
        return None
    if kind == "ssn":
        m = SSN.match(text, at)
        return m and m.span()
    if kind == "number":
        m = NUMBER.match(text, at)
        return m.span() if m and not DATE.fullmatch(m.group()) and sum(map(str.isdigit, m.group())) >= 5 and 6 <= m.end() - at <= 24 else None
    if barren[0] <= at < barren[1] or (kind == "login" and not assigned):
        return None
    m = WORD.match(text, at)
    if not m or DATE.fullmatch(m.group()):
        return None
    if not DIGITS.search(text, at, m.end()):
        barren[:] = m.span()
        return None
    size, lettered = m.end() - at, bool(LETTER.search(text, at, m.end()))
    if kind == "login":
        ok = size >= 4
    else:
        ok = ((assigned and size >= 8) or (size >= 20 and lettered)) and (lettered or size >= 12)
    return m.span() if ok else None


def spans(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans, by kind as in KINDS, then start."""
    if not text:
        return []
    out = list(_digits(text))
    mail = phone = address = account = 0
    barren = [0, 0]
    for last, (kind, size) in anchors.iter(lowered(text)):
        at = last - size + 1
        if kind == "@":
            if at >= mail and (found := _email(text, at, mail)):
                out.append(("email", *found))
                mail = found[1]
        elif kind == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "s":
            if at >= address and (found := _address(text, at, last + 1, address)):
                out.append(("address", *found))
                address = found[1]
        elif at >= account and not text[at - 1 : at].isalnum() and (found := _account(text, kind, last + 1, barren)):
            out.append(("account", *found))
            account = found[1]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written_as(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for b in batches:
        counts, hashed, joined = [], [], []
        for t in b.column(1):
            found = spans(t.as_py(), anchors)
            base = [s for s in found if s[0] in BASE]
            counts.append([sum(s[0] == k for s in base) for k in BASE])
            hashed.append(hashlib.sha256(written_as(base).encode()).hexdigest())
            joined.append(written_as(found))
        per_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
        yield pa.RecordBatch.from_arrays([b.column(0), *per_kind, pa.array(hashed, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, anchors: ahocorasick.Automaton) -> str | None:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first kind."""
    if not text:
        return text
    merged: list[list] = []
    for k, a, b in sorted(spans(text, anchors), key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    if not merged:
        return text
    out, at = [], 0
    for k, a, b in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _redacted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    anchors = automaton()
    for texts in parts:
        yield pa.array([redact(t.as_py(), anchors) for t in texts], pa.string())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text is replaced by markers such as <EMAIL>; n_chars counts the new text; every row stays."""
    bounded_batches(spark)
    out = docs.withColumn("text", _redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
