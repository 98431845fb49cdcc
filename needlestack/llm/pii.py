"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes
and identifier cues. A small parser for each kind expands its anchor to both sides and
validates what it gets. No pattern is searched for from every position of the text.

Kinds, in this order: email, ip, card, phone (the base kinds), then what cues and schemes
add: login (a web address with a user name in it, its scheme in any case), handle (@name),
account (an identifier with four digits after its cue, in groups with single blanks between
them, of which every later group holds a digit; an IBAN ends at its country's length and must
pass its checksum), secret (a value after a password or token cue, or an access key id).
Values have no upper length: a quoted secret ends at its closing quote, any other at a blank,
quote, comma or semicolon, and a login's password at the last at-sign before its host.

Spans are in code points, end exclusive. Matches of one kind do not overlap; a match that
fails its check is dropped and still counts as passed over. A null text is empty; texts
may be of any length: each anchor is expanded once and no long run of characters twice, so
work is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import _once

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "handle", "account", "secret")

# Cues in lower case; they are also found capitalised and in capitals.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
SCHEMES = ("https", "http", "ftp", "ssh")
KEY_IDS = ("AKIA", "ASIA")
# Characters of an IBAN by country: the registry's, then those in use without an entry there.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
IBAN_LENGTHS |= {country: n for n, countries in {
    25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD",
    28: "BF BJ CI MA ML NE SN TG"}.items() for country in countries.split()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_ip = re.compile(r"[0-9]++(?:\.[0-9]++){3}").match
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_login = re.compile(r"[A-Za-z0-9._%+~-]++(?::[^\s/@]*+(?:@[^\s/?#@]*+)*)?@[A-Za-z0-9.-]+").match
_handle = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,29}+(?![A-Za-z0-9_.@-])").match
_after_account = re.compile(r"(?i:\s?(?:no|nr|number|id)\b\.?)?[\x20\t]{0,2}[:=#]?[\x20\t]{0,2}(?=[A-Z0-9])").match
_group = re.compile(r"[A-Z0-9][A-Z0-9-]*+").match
_next_group = re.compile(r"\x20(?=[A-Z-]*[0-9])[A-Z0-9][A-Z0-9-]*+(?![A-Za-z0-9])").match
_after_iban = re.compile(r"[\x20\t]{0,2}[:=#]?[\x20\t]{0,2}(?=[A-Z]{2}[0-9]{2})").match
_iban_of = {n: re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){%d}" % (n - 4)).match for n in set(IBAN_LENGTHS.values())}
_any_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+").match
_after_secret = re.compile(r"[\x20\t]{0,2}[:=][\x20\t]{0,2}"
                           r"(?:\"((?:[^\"\\\r\n]|\\[^\r\n]){8,}+)\"|'((?:[^'\\\r\n]|\\[^\r\n]){8,}+)'|[\"']?([^\s\"',;]{8,}+))").match
_key_tail = re.compile(r"[A-Z0-9]{16}+(?![A-Za-z0-9])").match


def _automaton():
    made = ahocorasick.Automaton()
    for sign in "@+0123456789":
        made.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                made.add_word(form, ("iban" if cue == "iban" else kind, len(form)))
    made.add_word("://", ("scheme", 3))
    for key in KEY_IDS:
        made.add_word(key, ("key", len(key)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """Where the valid IBAN that begins here ends; 0 without one. An unlisted country's is all that could belong to it."""
    found = _iban_of.get(IBAN_LENGTHS.get(text[start:start + 2]), _any_iban)(text, start)
    return found.end() if found and iban(found[0]) else 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class Finder:
    """All spans of a text, from one pass over its anchors."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind number, end), by start and then kind."""
        out: list[tuple[int, int, int]] = []
        if not text:
            return out
        email_end = ip_end = card_end = phone_end = other_end = not_account = 0
        last_digit = -2
        for at, (kind, length) in self.anchors.iter(text):
            if kind == "digit":
                inside, last_digit = at == last_digit + 1, at
                if inside:
                    continue
                if at >= ip_end and (m := _ip(text, at)):
                    ip_end = m.end()
                    if all(map(_small, m.group().split("."))):
                        out.append((at, 1, ip_end))
                if at >= card_end and (m := _card(text, at)):
                    card_end = m.end()
                    digits = _digits(m.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, card_end))
            elif kind == "@":
                start = at
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := _domain(text, at + 1)):
                    email_end = m.end()
                    out.append((start, 0, email_end))
                elif (at == 0 or text[at - 1] not in LOCAL) and (m := _handle(text, at + 1)):
                    out.append((at, 5, m.end()))
            elif kind == "+":
                if at >= phone_end and (m := _phone(text, at)):
                    phone_end = m.end()
                    if 10 <= len(_digits(m.group())) <= 15:
                        out.append((at, 3, phone_end))
            elif kind == "scheme":
                before = text[max(at - 7, 0):at - 2].lower()
                scheme = next((x for x in SCHEMES if before.endswith(x)), None)
                if scheme and (m := _login(text, at + 1)):
                    out.append((at - 2 - len(scheme), 4, m.end()))
            else:
                start = at + 1 - length
                if start < other_end or start and text[start - 1] in WORD:
                    continue
                if kind == "key":
                    if m := _key_tail(text, at + 1):
                        out.append((start, 7, m.end()))
                        other_end = m.end()
                elif kind == "secret":
                    if m := _after_secret(text, at + 1):
                        out.append((m.start(m.lastindex), 7, m.end(m.lastindex)))
                        other_end = m.end(m.lastindex)
                elif kind == "iban":
                    if (m := _after_iban(text, at + 1)) and (end := iban_end(text, m.end())):
                        out.append((m.end(), 6, end))
                        other_end = end
                elif (m := _after_account(text, at + 1)) and (first := m.end()) >= not_account:
                    if not (end := iban_end(text, first)):
                        end = _group(text, first).end()
                        whole = not (end < len(text) and text[end] in WORD and text[end] != "_")
                        while whole and (m := _next_group(text, end)):
                            end = m.end()
                        found = text[first:end]
                        if not whole or len(found.replace(" ", "")) < 6 or len(_digits(found)) < 4:
                            not_account = end     # nor is any part of it that ends there
                            continue
                    out.append((first, 6, end))
                    other_end = end
        out.sort()
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_worker: dict = {}


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every whole text; one narrow pass."""
    return _mapped(docs, id_col, text_col, False)


def personal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts, digest and joined spans."""
    return _mapped(docs, id_col, text_col, True)


def _mapped(docs: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if digests:
        rest = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    else:
        rest = "spans array<struct<kind:string,start:long,end:long>>"
    schema = T.StructType([plain.schema["id"], *T.StructType.fromDDL(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _once(_worker, "finder", Finder).spans
        for batch in batches:
            found = [find(text.as_py()) for text in batch.column(1)]
            if not digests:
                kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
                columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found],
                                    pa.list_(kind))]
            else:
                base = [[x for x in spans if x[1] < len(BASE_KINDS)] for spans in found]
                columns = [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64())
                           for k in range(len(BASE_KINDS))]
                columns += [pa.array([sha256(joined(x).encode()).hexdigest() for x in base], pa.string()),
                            pa.array([joined(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)
    return plain.mapInArrow(run, schema)
