"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, "+" before a digit, digit pairs,
dotted digits, schemes and identifier cues. From each anchor a small parser expands to the
boundaries of the value and validates it. A parser resumes behind what it has read, so a text
costs time in proportion to its length whatever it holds.

Base kinds (leftmost, non-overlapping for each kind; a match that fails its check is dropped
and not tried again):

- email  local@label(.label)+ over ASCII letters, digits and ._%+- / letters, digits and -
- ip     four dotted numbers of at most 255
- card   12 to 19 digits, single spaces or hyphens between them, Luhn sum divisible by ten
- phone  "+", a digit, digits with space . ( ) -, a digit; 9 to 15 digits

Added kinds, never overlapping a base span or each other:

- intl_email  an address with letters beyond ASCII
- login       user:password before the host of a URL
- ipv6        a bracketed address behind a scheme
- iban        behind a cue, 15 to 34 letters and digits with valid check digits
- account     behind a cue, an account number of 6 to 20 digits
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("intl_email", "login", "ipv6", "iban", "account")
KINDS = BASE_KINDS + ADDED_KINDS
CUES = {
    "iban": ("iban", "Iban", "IBAN"),
    "account": ("account", "Account", "ACCOUNT", "acct", "Acct", "konto", "Konto", "cuenta", "Cuenta", "compte", "Compte"),
}
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_INTL_DOMAIN = re.compile(r"@[^\W_](?:[\w-]*+)(?:\.[^\W_][\w-]*+)++")
_LOGIN = re.compile(r"://([^\s/@:\[\]]++:[^\s/@]++)@")
_IPV6 = re.compile(r"://\[([0-9A-Fa-f:.]{2,45})\]")  # the longest way to write one has 45 characters
_IBAN = re.compile(r"[\s:#.no-]*+([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[\s:#.-]|number|Number|nummer|no\b|No\b|nr\b|Nr\b)++([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "email")
    found.add_word("://", "scheme")
    for a in "0123456789":
        found.add_word(f"+{a}", "phone")
        for b in "0123456789":
            found.add_word(f"{a}.{b}", "ip")
            for gap in ("", " ", "-"):
                found.add_word(f"{a}{gap}{b}", "card" + gap)
    for kind, words in CUES.items():
        for word in words:
            found.add_word(word, kind)
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban_fits(value: str) -> bool:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of one text as (kind, start, end, base), by start, then kind; none for null."""
    if not text:
        return []
    spans: list[tuple[str, int, int, bool]] = []
    added: list[tuple[str, int, int, bool]] = []
    mail = dotted = card = phone = intl = 0  # each parser has read up to here
    for last, what in _AUTOMATON.iter(text):
        if what == "email":
            start = last
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, last) if start < last else None
            if found:
                spans.append(("email", start, mail := found.end(), True))
            else:
                start = last
                while start > intl and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
                    start -= 1
                if start < last and (found := _INTL_DOMAIN.match(text, last)):
                    added.append(("intl_email", start, intl := found.end(), False))
                else:
                    intl = last + 1
            if not found:
                mail = last + 1
        elif what == "ip":
            if last < dotted:
                continue
            start = last - 2
            while start > dotted and text[start - 1] in _DIGIT:
                start -= 1
            found = _DOTTED.match(text, start)
            dotted = found.end()
            parts, at = found[0].split("."), start
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_part_fits, four)):
                    spans.append(("ip", at, end, True))
                at = end + 1
        elif what == "phone":
            if last - 1 < phone or not (found := _PHONE.match(text, last - 1)):
                continue
            end = found.end()
            while text[end - 1] not in _DIGIT:
                end -= 1
            if end - last >= 3:
                phone = end
                if 9 <= sum(c in _DIGIT for c in text[last:end]) <= 15:
                    spans.append(("phone", last - 1, end, True))
        elif what[:4] == "card":
            start = last - len(what) + 3
            if start < card:
                continue
            found = _CARD.match(text, start)
            card = found.end()
            digits = found[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", start, card, True))
        elif what == "scheme":
            if found := _LOGIN.match(text, last - 2):
                added.append(("login", *found.span(1), False))
            elif found := _IPV6.match(text, last - 2):
                try:
                    ipaddress.IPv6Address(found[1])
                except ValueError:
                    continue
                added.append(("ipv6", *found.span(1), False))
        elif what == "iban":
            if (found := _IBAN.match(text, last + 1)) and _iban_fits(found[1]):
                added.append(("iban", *found.span(1), False))
        elif found := _ACCOUNT.match(text, last + 1):
            added.append(("account", *found.span(1), False))
    return _merged(spans, added) if added else sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _merged(spans: list, added: list) -> list:
    """Added spans, by start and then kind, that touch no base span and no added one before."""
    taken = sorted((s[1], s[2]) for s in spans)
    kept, at, free = [], 0, 0
    for s in sorted(added, key=lambda s: (s[1], KINDS.index(s[0]))):
        while at < len(taken) and taken[at][0] < s[2]:
            free, at = max(free, taken[at][1]), at + 1
        if s[1] >= free:
            kept.append(s)
            free = s[2]
    return sorted(spans + kept, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None, spans: list) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += (text[at:start], f"<{kind.upper()}>")
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and `spans`, sorted by start, then kind.

    Null and empty texts have no spans; repeated rows give repeated results; an empty table
    gives an empty one. Only the two named columns are read, so other columns cannot clash.
    Offsets count code points, the end is exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], names=["id", "spans"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All documents and columns, the text with personal data replaced, its length counted anew.

    Rows without findings are unchanged; null texts stay null (their length too).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [redact(t, scan(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    clean = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        clean = clean.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return clean


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        id_col, *counts,
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
