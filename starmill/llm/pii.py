"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the places where personal data can be: at-signs, scheme
separators, plus signs, digits and cue words. From each anchor a deterministic local parser expands
to the left and right, fixes the boundaries and validates (number ranges, check digits). Text
between anchors is never looked at again.

Base kinds, found exactly as a leftmost, non-overlapping search per kind would find them: ``email``,
``ip``, ``card``, ``phone``. Added kinds: ``login`` (user and password in a URL), ``secret`` (value
after a cue such as ``token =``), ``account`` (IBAN, or digits after an account cue) and ``street``
(house number, names and a street word). Kinds may overlap each other.

Spans are ``kind:start:end`` in code points, the end exclusive, by start, then kind as listed.

Defined results: a null text is an empty text (no spans); repeated rows are searched row by row;
extra columns are ignored by ``find_personal_data`` and kept by ``redact``; an empty table gives
an empty result. Whole texts are searched, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.llm.words import as_text, free_name, struct_udf

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "account", "street")
RANK = {kind: i for i, kind in enumerate(KINDS)}

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]*(?=@)")
SECRET = re.compile(r"[\x20\t]*[=:][\x20\t]*[\"']?([A-Za-z0-9+/_-]{16,})")
IBAN = re.compile(r"[\x20:#.]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"[\x20:#.]*(?:(?:no|nr|number)[\x20:#.]*)?([0-9][0-9-]{4,22}[0-9])", re.I)
STREET_NAMES = re.compile(r"[0-9]{1,5}(?:\x20[A-Z][a-z]{1,30}){1,3}\x20$")

# Cue words.
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey", "access_key")
ACCOUNT_CUES = ("account", "acct", "passport", "ssn")
STREET_WORDS = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard")


@cache
def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for symbol, kind in (("@", "email"), ("+", "phone"), ("://", "login")):
        automaton.add_word(symbol, (kind, len(symbol)))
    for digit in DIGITS:
        automaton.add_word(digit, ("digit", 1))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("iban", ("iban",))):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                automaton.add_word(form, (kind, len(form)))
    for word in STREET_WORDS:
        automaton.add_word(word, ("street", len(word)))
    automaton.make_automaton()
    return automaton


def digits_of(span: str) -> str:
    return "".join(c for c in span if c in DIGITS)


def at_most_255(digits: str) -> bool:
    number = digits.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def iban_valid(text: str) -> bool:
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def longest_iban(text: str, start: int, end: int) -> int:
    """End of the longest valid IBAN that begins at ``start``; ``start`` if there is none."""
    for stop in range(end, start + 14, -1):
        if text[stop - 1] != " " and iban_valid(text[start:stop]):
            return stop
    return start


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of all personal data, in order."""
    found: list[tuple[int, str, int]] = []
    done = dict.fromkeys(("email", "ip", "card", "phone"), 0)  # no span of the kind begins before
    size = len(text)
    for last, (anchor, length) in anchors().iter(text):
        start, after = last - length + 1, last + 1
        if anchor == "digit":
            if last >= done["card"]:
                match = CARD.match(text, last)
                if match:
                    done["card"] = match.end()
                    digits = digits_of(match.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, "card", match.end()))
            if last >= done["ip"] and (
                last == done["ip"] or last == 0 or text[last - 1] not in DIGITS
            ):
                match = ADDRESS.match(text, last)
                if match:
                    done["ip"] = match.end()
                    parts = match.group().split(".")
                    if all(at_most_255(p) for p in parts):
                        found.append((last, "ip", match.end()))
        elif anchor == "email":
            left = last
            while left > done["email"] and text[left - 1] in LOCAL_PART:
                left -= 1
            match = DOMAIN.match(text, after) if left < last else None
            if match:
                done["email"] = match.end()
                found.append((left, "email", match.end()))
        elif anchor == "phone":
            match = PHONE.match(text, last) if last >= done["phone"] else None
            if match:
                done["phone"] = match.end()
                if 10 <= len(digits_of(match.group())) <= 15:
                    found.append((last, "phone", match.end()))
        elif anchor == "login":
            match = LOGIN.match(text, after)
            if match:
                found.append((after, "login", match.end()))
        elif anchor == "street":
            match = STREET_NAMES.search(text, max(0, start - 110), start)
            if match and (after == size or not text[after].isalnum()):
                found.append((match.start(), "street", after))
        elif after == size or not text[after].isalnum():
            if anchor == "secret":
                match = SECRET.match(text, after)
                if match:
                    found.append((match.start(1), "secret", match.end(1)))
            elif anchor == "account":
                match = ACCOUNT.match(text, after)
                if match:
                    found.append((match.start(1), "account", match.end(1)))
            else:
                match = IBAN.match(text, after)
                end = longest_iban(text, match.start(1), match.end(1)) if match else 0
                if match and end > match.start(1):
                    found.append((match.start(1), "account", end))
    return sorted(set(found), key=lambda s: (s[0], RANK[s[1]], s[2]))


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _find(texts: pa.Array) -> pa.Array:
    counts: list[list[int]] = [[] for _ in BASE]
    base, spans = [], []
    for text in as_text(texts):
        found = find_spans(text)
        kinds = [kind for _, kind, _ in found]
        for column, kind in zip(counts, BASE, strict=True):
            column.append(kinds.count(kind))
        own = listed([s for s in found if s[1] in BASE])
        base.append(hashlib.sha256(own.encode()).hexdigest())
        spans.append(listed(found))
    return pa.StructArray.from_arrays(
        [*[pa.array(c, pa.int64()) for c in counts], pa.array(base), pa.array(spans)],
        names=[*[f"n_{k}" for k in BASE], "base_sha256", "spans"],
    )


def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([redacted(t) if t is not None else None for t in texts.to_pylist()], pa.string())


def redacted(text: str) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    parts, at, end = [], 0, -1
    for start, kind, stop in find_spans(text):
        if start >= end:
            parts += [text[at:start] if at < start else "", f"<{kind.upper()}>"]
        end = at = max(end, stop)
    return "".join([*parts, text[at:]])


_FIELDS = ", ".join([*[f"n_{k} bigint" for k in BASE], "base_sha256 string", "spans string"])


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of the base kinds, SHA-256 of the base spans, all spans."""
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = narrow.select("key", struct_udf(_FIELDS, _find)(F.col("text")).alias("f"))
    return found.select(F.col("key").alias(key), "f.*")


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with every span replaced by its kind (``<EMAIL>``) and ``length``, if the table has
    that column, brought up to date. A null text stays null."""
    clean = free_name(df, "_clean")
    out = df.withColumn(clean, struct_udf("string", _redact)(F.col(text)))
    new = {text: F.col(clean)}
    if length in df.columns:
        new[length] = F.when(F.col(text).isNull(), F.col(length)).otherwise(
            F.length(clean).cast(df.schema[length].dataType)
        )
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])
