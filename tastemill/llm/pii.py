"""Operator 5: format-preserving Feistel pseudonyms for personal data.

Validated values (card numbers, bank accounts, social security and phone numbers, network
and e-mail addresses, calendar dates, secrets) are replaced by values of the same format:
each is read as a number of a finite domain, permuted by a keyed Feistel network with
cycle walking, and written back with its separators and check digits. The permutation
depends on the key, the kind and the format alone, so equal values get equal pseudonyms
in all documents, and different ones stay different.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._text import column_bytes, pieces

KINDS = ("email", "card", "account", "social", "phone", "address", "date", "secret")
OUTPUT = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network on two halves, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, seed = (1 << half) - 1, tweak.encode()
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            digest = hashlib.blake2b(seed + bytes([i]) + right.to_bytes(half // 8 + 1, "big"), key=key, digest_size=half // 8 + 9).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def permute_letters(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Letters and digits permuted, each position within its own alphabet; other signs stay."""
    alphabets = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            alphabets.append("0123456789abcdef")
        else:
            alphabets.append(next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), ""))
    size, value = 1, 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            size, value = size * len(a), value * len(a) + a.index(c)
    shape = "".join(f"{len(a)}," if a else c for c, a in zip(text, alphabets, strict=True))
    value, out = permute(value, size, key, f"{tweak}:{shape}"), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, at = divmod(value, len(a))
            out.append(a[at])
        else:
            out.append(c)
    return "".join(reversed(out))


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _respaced(shape: str, digits: str) -> str:
    """``digits`` in the places where ``shape`` has digits or letters."""
    own = iter(digits)
    return "".join(next(own) if c.isalnum() else c for c in shape)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn_ok(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2  # the issuer's digit stays, the check digit follows from the rest
    body = digits[0] + str(permute(int(digits[1:-1]), 10**n, key, f"card{digits[0]}.{n}")).zfill(n)
    return _respaced(text, next(body + str(c) for c in range(10) if luhn_ok(body + str(c))))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def account(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permute_letters(plain[4:], key, "account" + plain[:2])
    return _respaced(text, f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")


def social(text: str, key: bytes) -> str | None:
    value = int(text.replace("-", ""))

    def valid(v: int) -> bool:
        area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    if not valid(value):
        return None
    value = permute(value, 10**9, key, "social")
    while not valid(value):
        value = permute(value, 10**9, key, "social")
    return _respaced(text, f"{value:09d}")


def phone(text: str, key: bytes) -> str | None:
    country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d{1,2}", text)
    head = country[0] if country else ""
    digits = re.sub(r"\D", "", text[len(head) :])
    if not 6 <= len(digits) <= 12:
        return None
    return head + _respaced(text[len(head) :], str(permute(int(digits), 10 ** len(digits), key, f"phone{head}.{len(digits)}")).zfill(len(digits)))


def address(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(x != str(int(x)) for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "address")
    return ".".join(map(str, value.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    """Dates stay in their century and format (year-month-day, or day or month first)."""
    sign = next(c for c in text if not c.isdigit())
    parts = text.split(sign)
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy",) if sign == "." else ("mdy", "dmy") if sign == "/" else ("dmy",)
    for order in orders:
        at = {k: int(p) for k, p in zip(order, parts, strict=True)}
        try:
            day = dt.date(at["y"], at["m"], at["d"]).toordinal()
        except ValueError:
            continue
        century = max(at["y"] // 100 * 100, 1)
        first, last = dt.date(century, 1, 1).toordinal(), dt.date(at["y"] // 100 * 100 + 99, 12, 31).toordinal()
        new = dt.date.fromordinal(first + permute(day - first, last - first + 1, key, f"date{century}"))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sign.join(values[k] for k in order)
    return None


def email(text: str, key: bytes) -> str | None:
    name, _, domain = text.rpartition("@")
    owner, _, top = domain.rpartition(".")
    return f"{permute_letters(name, key, 'email' + domain)}@{permute_letters(owner, key, 'domain' + top)}.{top}"


def secret(text: str, key: bytes) -> str | None:
    return permute_letters(text, key, "secret", hexadecimal=not re.search(r"[^0-9a-f]", text))


# Formats, tried in this order at every place; the named group is the value.
_PATTERN = re.compile(
    r"(?:(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9+/_.-]{8,}))"
    r"|(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<account>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<address>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<date>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./-])\d{2}(?P<between>[./-])\d{2}(?P=between)\d{4}(?![\d./-]*\d))"
    r"|(?P<social>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\d+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d))"
)
_MAKERS = {"email": email, "card": card, "account": account, "social": social, "phone": phone, "address": address, "date": date, "secret": secret}
#: a value holds a digit or an at sign, or follows an equals sign or colon
_HINTS = re.compile("[0-9@=:]+")
_HINT = np.zeros(256, dtype=bool)
_HINT[[*range(ord("0"), ord("9") + 1), ord("@"), ord("="), ord(":")]] = True


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how many values of each kind there were."""
    found: dict[str, int] = {}

    def replaced(part: str) -> str:
        out, at = [], 0
        while m := _PATTERN.search(part, at):
            kind = next(k for k in _MAKERS if m.group(k) is not None)
            spans = _card_spans(m.group(kind)) if kind == "card" else [(0, len(m.group(kind)))]
            for a, b in spans:
                a, b = a + m.start(kind), b + m.start(kind)
                if (new := _MAKERS[kind](part[a:b], key)) is not None:
                    found[kind] = found.get(kind, 0) + 1
                    out += [part[at:a], new]
                    at = b
                    break
            else:  # no valid value here: on behind its first run of letters and digits
                skip = m.start() + max(1, len(re.match(r"\W*\w*", m.group(0))[0]))
                out.append(part[at:skip])
                at = skip
        return "".join([*out, part[at:]])

    out, done = [], 0
    for start, end in _islands(text):
        out += [text[done:start], replaced(text[start:end])]
        done = end
    out.append(text[done:])
    return "".join(out), found


def _card_spans(text: str) -> list[tuple[int, int]]:
    """Where in a row of digit groups a card number can stand: one group first, then 16 digits, then others."""
    groups = [m.span() for m in re.finditer(r"\d+", text)]
    spans = [(groups[i][0], groups[j][1]) for i in range(len(groups)) for j in range(i, len(groups))]
    digits = {s: sum(c.isdigit() for c in text[s[0] : s[1]]) for s in spans}
    single = set(groups)
    return sorted((s for s in spans if 13 <= digits[s] <= 19), key=lambda s: (s not in single, digits[s] != 16, -digits[s], s))


def _islands(text: str, margin: int = 96) -> list[list[int]]:
    """The parts of a text that can hold a value: around every hint, ending at white space."""
    out: list[list[int]] = []
    for m in _HINTS.finditer(text):
        if out and m.start() - margin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], m.end() + margin)
        else:
            out.append([max(0, m.start() - margin), m.end() + margin])
    for island in out:
        while island[0] > 0 and not text[island[0] - 1].isspace():
            island[0] -= 1
        while island[1] < len(text) and not text[island[1]].isspace():
            island[1] += 1
    joined: list[list[int]] = []
    for island in out:
        if joined and island[0] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], island[1])
        else:
            joined.append(island)
    return joined


def pseudonyms(df: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_email, n_card, ...) of each row, with the pseudonymised whole text.

    Null text stays null with zero counts; empty text stays empty. Null doc_id and
    repeated rows: treated row by row, equal texts come out equal. Empty table: no rows.
    Other columns are ignored. ``key``: up to 64 secret bytes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            buf, offsets = column_bytes(piece.column(1))
            hints = np.concatenate([[0], np.cumsum(_HINT[buf])])[offsets]
            column, changed = piece.column(1), {}
            counts = {k: np.zeros(piece.num_rows, np.int64) for k in KINDS}
            for i in np.flatnonzero(np.diff(hints)).tolist():
                text = column[i].as_py()
                new, found = pseudonymise(text, key)
                if found:
                    changed[i] = new
                    for k, n in found.items():
                        counts[k][i] = n
            if changed:
                mask = np.zeros(piece.num_rows, dtype=bool)
                mask[list(changed)] = True
                import pyarrow.compute as pc

                column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(changed.values()), column.type))
            yield pa.RecordBatch.from_arrays([piece.column(0), column, *(pa.array(counts[k]) for k in KINDS)], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, OUTPUT)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deployment passes its own secret; a fixed one keeps the registered query repeatable
    return pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet"), b"registered query")
