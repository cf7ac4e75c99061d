"""Personal data replaced by format-preserving pseudonyms.

A value becomes an integer below the number of values of its format, a keyed Feistel network over twice as many half bits permutes it
(walking the cycle until it is in range again), and the result is written in the format. Equal values therefore have equal pseudonyms in
all documents, different values different ones, separators stay where they are, and what was valid stays valid:

* payment cards (13 to 19 digits, Luhn): payload permuted, check digit recomputed
* IBANs (mod 97): country kept, letters and digits permuted in place, check digits recomputed
* US social security numbers: permuted within the valid ones
* phone numbers with a country code, or of ten digits in three groups: the digits after the country code permuted, by their number, so that
  all notations of a number stay linked, with a country code or without
* IPv4 addresses: permuted as 32-bit numbers
* calendar dates (year-month-day, day/month/year, day.month.year; month/day/year where it can be no other) from 1000 to 2999: permuted as
  days, so that all notations of a day stay linked
* e-mail addresses: letters and digits of the local part and host, without the last label, permuted in place
* secrets with a digit after a name such as token, password or api_key, and cloud access keys: letters and digits drawn anew by a keyed
  digest of the secret, so that equal ones stay linked but the key does not bring one back

The key is the caller's. The query and the pipeline take it from ``spark.runlens.pii.secret`` and else draw one for the application: without
a key that is kept, pseudonyms link documents of one application and of no other.

Values that fail validation stay. A card, IBAN or phone number beside more digits or capitals is searched in the whole run: where the
longest match is not valid or overlaps an earlier kind, shorter ends and later starts at its separators are tried. Texts without any stay as
they are, null texts null, empty texts empty; texts of any length are taken whole, and work grows with their length. Rows are independent of
each other; repeated rows give equal results. All columns of ``docs`` are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, pieces

ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
CLASS = {c: a for a in ALPHABETS for c in a}
HEX = "0123456789abcdef"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1000, 1, 1).toordinal(), datetime.date(2999, 12, 31).toordinal()


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the integers below ``size``: balanced Feistel, cycle-walked into range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            h = hashlib.blake2b(right.to_bytes(width, "big"), digest_size=min(64, width + 8), key=key, person=bytes([i]), salt=tweak.encode()[:16])
            f = int.from_bytes(h.digest(), "big") if width <= 56 else int.from_bytes(hashlib.shake_256(h.digest()).digest(width + 8), "big")
            left, right = right, left ^ (f & mask)
        value = left << half | right
        if value < size:
            return value


def in_place(text: str, key: bytes, tweak: str, alphabets: dict[str, str] = CLASS) -> str:
    """Characters of known alphabets permuted as one mixed-radix number; all others stay."""
    value, size = 0, 1
    for c in text:
        if a := alphabets.get(c):
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(value, size, key, tweak)
    out = []
    for c in reversed(text):
        if a := alphabets.get(c):
            value, at = divmod(value, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def digits_in(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != digits[-1]:
        return None
    payload = str(permuted(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return digits_in(text, payload + luhn(payload))


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = in_place(plain[4:], key, "iban")
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    if not ssn_valid(d):
        return None
    while True:
        d = str(permuted(int(d), 10**9, key, "ssn")).zfill(9)
        if ssn_valid(d):
            return digits_in(text, d)


#: Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", *map(str, range(40, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"} - {"42"}


def phone(text: str, key: bytes) -> str | None:
    trunk = re.search(r"\(0\)", text) if text.startswith("+") else None  # a zero that is dialled at home only
    at = [i for i, c in enumerate(text) if c.isdigit() and not (trunk and trunk.start() < i < trunk.end())]
    digits = "".join(text[i] for i in at)
    if not 8 <= len(digits) <= 15:
        return None
    code = next((n for n in (1, 2) if digits[:n] in CODES), 3) if text.startswith("+") else 0
    code = code if len(digits) - code >= 6 else 0
    rest = digits[code:]
    new = str(permuted(int(rest), 10 ** len(rest), key, f"phone{len(rest)}")).zfill(len(rest))
    out = list(text)
    for i, c in zip(at[code:], new):
        out[i] = c
    return "".join(out)


def ipv4(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()
    readings = [(a, b, c, "ymd")] if len(a) == 4 else [(c, b, a, "dmy"), *([(c, a, b, "mdy")] if sep == "/" else [])]
    for year, month, day, form in readings:
        try:
            at = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= at <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permuted(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            part = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return sep.join(part[x] for x in form)
    return None


def email(text: str, key: bytes) -> str | None:
    local, host = text.rsplit("@", 1)
    labels, last = host.rsplit(".", 1)
    return f"{in_place(local, key, 'local')}@{in_place(labels, key, 'host')}.{last}"


def drawn(text: str, key: bytes, tweak: str, alphabets: dict[str, str] = CLASS) -> str:
    """Characters of known alphabets drawn from a keyed digest of the text; all others stay."""
    value = int.from_bytes(hashlib.shake_256(hashlib.blake2b(text.encode(), key=key, person=tweak.encode()[:16]).digest()).digest(len(text) + 16), "big")
    out = []
    for c in text:
        if a := alphabets.get(c):
            value, at = divmod(value, len(a))
            c = a[at]
        out.append(c)
    return "".join(out)


def secret(text: str, key: bytes) -> str | None:
    if not DIGIT.search(text):
        return None
    if re.fullmatch(r"[0-9a-f]+", text) and len(text) >= 16:
        return drawn(text, key, "secret", {c: HEX for c in HEX})
    return drawn(text, key, "secret")


def access_key(text: str, key: bytes) -> str | None:
    return text[:4] + drawn(text[4:], key, "access", {c: ALPHABETS[2] + "0123456789" for c in ALPHABETS[2] + "0123456789"})


DIGIT = re.compile(r"\d")
#: (kind, what a text must hold to be searched, pattern, group that is replaced, pseudonym); earlier kinds win.
KINDS = (
    ("secret", re.compile(r"(?i)token|passw|pwd|secret|api.?key|access.?key|credential|auth"),
     re.compile(r"""(?i)(?:token|passw(?:or)?d|passwd|pwd|secret|api[_-]?key|access[_-]?key|credential|auth)(?:s|\d{1,4}|key|value)?(?:[_-][\w-]{0,40})?["']?\s{0,3}[=:]\s{0,3}["']?([\w+/~-]{6,}={0,2})"""), 1, secret),
    ("access_key", re.compile("A[KS]IA"), re.compile(r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)"), 0, access_key),
    ("email", re.compile("@"), re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"), 0, email),
    ("iban", re.compile(r"[A-Z]{2}\d\d"), re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), 0, iban),
    ("date", None, re.compile(r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\w/]|[-.]\d)"), 0, date),
    ("ipv4", None, re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"), 0, ipv4),
    ("ssn", None, re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 0, ssn),
    ("phone", None, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"), 0, phone),
    ("card", None, re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"), 0, card),
)
#: Separators of groups at which a match that fails may end earlier or begin later, and the least characters between them.
GROUPED = {"iban": (" ", 15), "phone": (" .-", 8), "card": (" -", 13)}
KEY_SETTING = "spark.runlens.pii.secret"


@functools.lru_cache(maxsize=8)
def _own_key(app: str) -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one of this application that nobody else has."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _own_key(spark.sparkContext.applicationId)


def shorter(kind: str, text: str, a: int, b: int, inner: bool) -> Iterator[tuple[int, int]]:
    """Spans within a match, itself first, then by start and descending end; ``inner`` for one that begins within another.

    A part of a run of digits counts as a card if all its groups but the last have three digits or more, as cards are written:
    among the parts of a run of small numbers some would pass the check digit by chance.
    """
    seps, least = GROUPED.get(kind, ("", 0))
    cuts = [i for i in range(a, b) if text[i] in seps]
    for x in [a, *(i + 1 for i in cuts)] if kind == "card" else [a]:
        for e in [b, *reversed(cuts)]:
            if e - x < least:
                break
            part = inner or (x, e) != (a, b)
            if not (part and kind == "card" and any(len(g) < 3 for g in re.split("[ -]", text[x:e])[:-1])):
                yield x, e


class Pseudonyms:
    """Pseudonyms under a key, with those of recent values kept."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.make = {kind: functools.lru_cache(maxsize=1 << 14)(functools.partial(self.one, fn)) for kind, _, _, _, fn in KINDS}

    def one(self, fn, value: str) -> str | None:
        return fn(value, self.key)

    def replace(self, text: str | None) -> tuple[str | None, int]:
        """The text with pseudonyms, and how many values they replace."""
        if not text or not ("@" in text or DIGIT.search(text) or KINDS[0][1].search(text)):
            return text, 0
        taken: list[tuple[int, int, str]] = []
        covered = bytearray(len(text))
        for kind, hint, pattern, group, _ in KINDS:
            if hint and not hint.search(text):
                continue
            at = failed = 0
            while m := pattern.search(text, at):
                inner = m.start() < failed
                for a, b in shorter(kind, text, *m.span(group), inner):
                    if covered.find(1, a, b) >= 0:
                        continue
                    if (new := self.make[kind](text[a:b])) is not None:
                        taken.append((a, b, new))
                        covered[a:b] = b"\1" * (b - a)
                        at = b
                        break
                else:  # a value may begin within the match
                    at, failed = m.start() + 1, failed if inner else m.end()
        if not taken:
            return text, 0
        out, at = [], 0
        for a, b, new in sorted(taken):
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), len(taken)


@functools.lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: bytes, chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with pseudonyms in the text; a column of its length in code points follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pseudonyms(key)
        for batch in pieces(batches):
            done = [p.replace(t)[0] for t in batch.column(text_col).to_pylist()]
            cols = dict(zip(batch.schema.names, batch.columns))
            cols[text_col] = pa.array(done, batch.schema.field(text_col).type)
            if chars_col in cols:
                kind = batch.schema.field(chars_col).type
                sizes = [old if t is None else len(t) for t, old in zip(done, cols[chars_col].to_pylist())]
                cols[chars_col] = pa.array(sizes).cast(kind) if any(x is not None for x in sizes) else pa.nulls(len(sizes), kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Query: every document with pseudonyms, and how many it got."""
    docs, key = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pseudonyms(key)
        done = [p.replace(t) for t in batch.column("text").to_pylist()]
        cols = [batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_replaced"])

    return map_arrow(docs, run, "doc_id long, text string, n_replaced int")
