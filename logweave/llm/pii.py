"""Personal data by anchor expansion.

One Aho-Corasick automaton finds every anchor of a text in one pass: the at-sign, URL schemes,
plus signs, digits, and cue words of account numbers. From each anchor a small deterministic
parser walks outwards to the boundaries of an address, number or account, and validates it
(at most 255 in each part of an IPv4 address, Luhn for cards, 8 to 15 digits for telephones, the
mod-97 rule for IBANs). No parser looks back before the end of the last match of its kind, which
makes matches leftmost and non-overlapping.

Defined results: a null text counts as empty; an empty text has no span; equal rows give equal
rows; an empty table gives an empty result. Spans count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from .common import fields, map_rows, map_texts, sha, spans_text

#: Base kinds in their order, then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
SCHEMA = fields(n_email=LongType(), n_ip=LongType(), n_card=LongType(), n_phone=LongType(), base_sha256=StringType(), spans=StringType())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"[\x20().0-9-]+")
_IBAN = re.compile(r"[\x20:=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?))?\x20?[:#=]?\x20?([0-9][0-9-]{6,18}[0-9])")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_CUES = {"iban": "iban", "IBAN": "iban", "account": "account", "Account": "account", "acct": "account", "://": "login"}


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def finder():
    """A function from a text to its spans, by kind as in KINDS, then start."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for cue, kind in {"@": "email", "+": "phone", **dict.fromkeys("0123456789", "digit"), **_CUES}.items():
        auto.add_word(cue, kind)
    auto.make_automaton()

    def find(text: str) -> list[tuple[str, int, int]]:
        spans = {k: [] for k in KINDS}
        over = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
        for at, kind in auto.iter(text):
            if kind == "digit":
                if at >= over["card"]:
                    m = _CHAIN.match(text, at)
                    over["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(("card", at, m.end()))
                if at >= over["ip"]:
                    m = _DOTTED.match(text, at)
                    over["ip"] = m.end()
                    spans["ip"] += _addresses(m[0], at)
            elif kind == "email":
                start = at
                while start > over["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    spans["email"].append(("email", start, m.end()))
                    over["email"] = m.end()
            elif kind == "phone":
                if at >= over["phone"] and text[at + 1 : at + 2] in _DIGITS and (m := _PHONE.match(text, at + 2)):
                    end = m.end()
                    while text[end - 1] not in _DIGITS:
                        end -= 1
                    if end > at + 3:
                        over["phone"] = end
                        if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                            spans["phone"].append(("phone", at, end))
            elif at >= over[kind]:
                m = {"iban": _IBAN, "account": _ACCOUNT, "login": _LOGIN}[kind].match(text, at + 1)
                if m and (kind != "iban" or mod97(m[1])):
                    start = m.start() if kind == "login" else m.start(1)
                    spans[kind].append((kind, start, m.end()))
                    over[kind] = m.end()
        return [s for k in KINDS for s in spans[k]]

    return find


def _addresses(run: str, at: int) -> list[tuple[str, int, int]]:
    """IPv4 addresses of a run of numbers and single dots: each four numbers, from the left."""
    parts, found = run.split("."), []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            found.append(("ip", at, end))
        at = end + 1
    return found


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: counts of the base kinds, the digest of the base spans, and all spans."""

    def make():
        find = finder()

        def work(texts):
            found = [find(t or "") for t in texts]
            out = {f"n_{k}": [sum(s[0] == k for s in spans) for spans in found] for k in BASE}
            out["base_sha256"] = [sha(spans_text([s for s in spans if s[0] in BASE])) for spans in found]
            out["spans"] = [spans_text(spans) for spans in found]
            return out

        return work

    return map_texts(docs, make, SCHEMA, key, text)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, overlapping ones merged, replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(b, merged[-1][2]))
        else:
            merged.append((kind, a, b))
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; other columns as they are, null stays null."""
    names, schema = docs.columns, docs.schema
    at = names.index(text)

    def make():
        find = finder()

        def work(*columns):
            out = dict(zip(names, columns, strict=True))
            out[text] = [t if t is None else mask(t, find(t)) for t in columns[at]]
            return out

        return work

    return map_rows(docs, make, schema)
