"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The four base kinds follow their patterns exactly: matches are leftmost and do not overlap within a kind, and a match that
fails its check is dropped without another try. They always stay. Beyond them the method proposes

- ``iban``: country letters and 13 to 32 further characters, in groups of four or run together; modulo 97 must give 1 for
  the country's length, for the whole match, or, where the length is not known, for the match without its last groups;
- ``card_inside``: groups of digits laid out like a card number, inside a longer match that failed as a card; Luhn's check
  must hold;
- ``ipv6``: an address of that version, confirmed by its grammar;
- ``ssn``: three, two and four digits between dashes, no group of zeros; between spaces only with a word such as ssn nearby;
- ``secret``: 24 or more hexadecimal or 32 or more base-64 characters with a digit, taken only with a word such as token or key
  nearby, or an access key id with its fixed prefix;
- ``phone_local``: 7 to 15 digits without a plus sign, with separators or 10 to 12 run together, taken only with a word such
  as phone or call nearby.

Every proposal has the score of its kind; a confirmed checksum and each kind of supporting word among the 48 characters
before it and the 16 after raise it, words of plain numbering (order, invoice, page) lower it. Proposals of 0.5 or more are
spans. A proposal that overlaps a base span, or an earlier proposal of a kind listed before it, is left out.

Null text counts as empty; it has no spans. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import settle
from .common import short_batches, slices, tidied

# Patterns of the base kinds.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Every proposal but an address holds a digit.
DIGIT = re.compile(r"[0-9]")

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("card_inside", "iban", "ipv6", "ssn", "secret", "phone_local")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666)[0-9]{3}([ -])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9-])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{24,}+|[A-Za-z0-9+/_-]{32,}+={0,2})(?![A-Za-z0-9+/_=-])")
# Fixed value: prefixes of access key ids.
KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
PHONE_PLAIN = re.compile(r"(?<![0-9A-Za-z+.-])[0-9]{10,12}(?![0-9A-Za-z]|[.-][0-9])")
# Sizes of the groups of card numbers, as they are printed.
CARD_LAYOUTS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
PHONE_LOCAL = re.compile(r"(?<![0-9+])(?<![0-9][.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,5}){1,4}(?![.-]?[0-9])")
# Characters of an account number by country, from the register; the least of any country.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL,FK,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV "
        "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
        "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
        "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
IBAN_LEAST = 15

# Score of a proposal alone, what its supporting words add, and the words.
BASIC = {"card_inside": 0.3, "iban": 0.5, "ipv6": 0.4, "ssn": 0.4, "secret": 0.2, "phone_local": 0.2}
SUPPORT = {
    "card_inside": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|karte|carte|tarjeta)\b"),
    "ipv6": re.compile(r"(?i)\b(?:ip|ipv6|address|host|server)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|insurance)\b"),
    # Words may stand in a name, such as access_token.
    "secret": re.compile(r"(?i)(?<![^\W_])(?:token|secret|password|passwd|api[_ -]?key|apikey|bearer|credential)s?(?![^\W_])"),
    "phone_local": re.compile(r"(?i)\b(?:phone|telephone|tel|mobile|cell|call|fax|(?:my|your|his|her|our) number|telefon|teléfono|téléphone)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:order|invoice|page|version|isbn|issue|article)\b")
SUPPORTED, OPPOSED, CONFIRMED, LEAST = 0.35, -0.3, 0.3, 0.5
BEFORE, AFTER = 48, 16


def luhn(digits: str) -> bool:
    """The last digit makes the sum of the others, every second one doubled, a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Moved four characters to the end, letters as two digits, the number leaves 1 when divided by 97."""
    plain = iban.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and domain; the local part is what stands before the ``@``, back to the last match."""
    last = 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed matches of the base kinds, by kind and start."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    near = text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    return (
        BASIC[kind]
        + CONFIRMED * confirmed
        + SUPPORTED * bool(SUPPORT[kind].search(near))
        + OPPOSED * bool(AGAINST.search(near))
    )


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed account numbers: what follows in capitals is cut off, and a match of none is tried again from its next group."""
    at = 0
    while m := IBAN.search(text, at):
        groups = m[0].split(" ")
        cuts = [" ".join(groups[:k]) for k in range(len(groups), 0, -1)]
        sizes = [len(c) - c.count(" ") for c in cuts]
        known = IBAN_LENGTHS.get(m[0][:2])
        if known:
            tried = [c for c, n in zip(cuts, sizes, strict=True) if n == known] + cuts[:1]
        else:
            tried = [c for c, n in zip(cuts, sizes, strict=True) if n >= IBAN_LEAST]
        found = next((c for c in tried if mod97(c)), None)
        if found:
            yield m.start(), m.start() + len(found)
        at = m.start() + len(found or groups[0])


def cards_inside(text: str) -> Iterator[tuple[int, int]]:
    """Card numbers among the groups of digits of matches that are no card as a whole; leftmost, longest first."""
    for m in CARD.finditer(text):
        if m.end() - m.start() < 14 or (13 <= len(d := _digits(m[0])) <= 19 and luhn(d)):
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
        i = 0
        while i < len(groups):
            for j in range(min(len(groups), i + 5), i, -1):
                part = groups[i:j]
                digits = "".join(text[s:e] for s, e in part)
                if part != groups and tuple(e - s for s, e in part) in CARD_LAYOUTS and digits[0] in "23456" and luhn(digits):
                    yield part[0][0], part[-1][1]
                    i = j - 1
                    break
            i += 1


def is_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text).is_global or text.count(":") == 7
    except ValueError:
        return False


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for s, e in cards_inside(text):
        yield "card_inside", s, e, True
    for s, e in ibans(text):
        yield "iban", s, e, True
    for m in SSN.finditer(text):
        yield "ssn", *m.span(), m[1] == "-"
    if ":" in text:
        for m in IPV6.finditer(text):
            if is_ipv6(m[0]):
                yield "ipv6", *m.span(), True
    for m in KEY_ID.finditer(text):
        yield "secret", *m.span(), True
    for m in SECRET.finditer(text):
        if DIGIT.search(m[0]):
            yield "secret", *m.span(), False
    for m in PHONE_LOCAL.finditer(text):
        if 7 <= len(_digits(m[0])) <= 15:
            yield "phone_local", *m.span(), False
    for m in PHONE_PLAIN.finditer(text):
        yield "phone_local", *m.span(), False


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans, and the further spans with their scores, each by kind and start."""
    base, more, taken = base_spans(text), [], bytearray()
    if not DIGIT.search(text):
        return base, more
    for kind, s, e, confirmed in _proposals(text):
        if not taken:
            taken = bytearray(len(text))
            for _, a, b in base:
                taken[a:b] = b"x" * (b - a)
        value = 0.0 if any(taken[s:e]) else score(kind, text, s, e, confirmed)
        if value >= LEAST:
            more.append((kind, s, e, round(value, 3)))
            taken[s:e] = b"x" * (e - s)
    return base, more


def listed(spans) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


def spans_of(rows: DataFrame, key: str) -> DataFrame:
    """``key, spans``: every span of a row's whole text as ``kind, start, end, score`` (base kinds have score 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                base, more = find(text or "")
                found.append([{"kind": k, "start": s, "end": e, "score": 1.0} for k, s, e in base] + [{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "spans"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "text").mapInArrow(work, f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def report(rows: DataFrame, key: str) -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans`` of every row's whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list] = {k: [] for k in BASE_KINDS}
            hashes, texts, extra = [], [], []
            for text in batch.column(1).to_pylist():
                base, more = find(text or "")
                for k in BASE_KINDS:
                    counts[k].append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                texts.append(listed([*base, *more]))
                extra.append(len(more))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(hashes, pa.string()), pa.array(texts, pa.string()), pa.array(extra, pa.int64())]
            columns.append(pa.array([sum(n) for n in zip(extra, *counts.values())], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_more", "n_spans"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "text").mapInArrow(
        work,
        f"`{key}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_more bigint, n_spans bigint",
    )


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the earliest, then longest."""
    base, more = find(text)
    out, at = [], 0
    for s, e, kind in sorted(((s, e, k) for k, s, e in [*base, *[x[:3] for x in more]]), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


# Rows handed to Python at a time, and bytes of text cleaned in one step; a longer text is a step of its own.
ROWS, STEP_BYTES = 500, 4_000_000


def redacted(rows: DataFrame) -> DataFrame:
    """Rows with personal data in ``text`` replaced, written; null stays null, all other columns stay as they are."""
    at = rows.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, STEP_BYTES):
                part = batch.slice(a, b - a)
                clean = pa.array([None if t is None else redact(t) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(part.columns)], names=batch.schema.names)

    with short_batches(rows.sparkSession, ROWS):
        return settle(rows.mapInArrow(tidied(work), rows.schema), "redacted")
