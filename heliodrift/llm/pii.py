"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Five kinds are found in this order of kinds: ``email``, ``ip``, ``card``, ``phone``, ``iban``.
The first four are the base kinds: their matches are leftmost and do not overlap within a
kind, and one that fails its check (parts up to 255, Luhn, 9 to 15 digits) is dropped without
a second try. ``iban`` is confirmed by its remainder modulo 97. Context words within
``CONTEXT_CHARS`` code points raise or lower a span's score; base spans stay whatever their
score, an ``iban`` stays from ``KEEP_SCORE`` on.

Null and empty texts have no spans; very long texts are read whole in linear time; repeated
rows give repeated results; a null id is returned as it is; columns besides the id and the
text are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import free_memory, map_text, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
CONTEXT_CHARS = 40
KEEP_SCORE = 0.5
#: The score a confirmed span of each kind starts with.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
#: Words that make a kind likelier, and words that make it less likely.
CONTEXT_WORDS = {
    "email": ({"mail", "email", "contact", "write"}, {"example"}),
    "ip": ({"ip", "address", "server", "host", "login"}, {"version", "release", "section"}),
    "card": ({"card", "credit", "visa", "payment", "debit"}, {"isbn", "order", "serial"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax", "telefon"}, {"isbn", "order", "serial"}),
    "iban": ({"iban", "bank", "account", "konto", "transfer"}, {"serial", "key", "hash"}),
}
CONTEXT_STEP = 0.2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits whose first digit starts no match has no later start either, hence the
# look-behind: the same matches without a quadratic search.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WORD = re.compile(r"[a-z]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The remainder of an account number, its first four signs moved to its end, is one."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(sign, 36)) for sign in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at + 1)):
            end = match.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _IP.finditer(text)
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))
    ]


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = _NOT_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(match.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [
        m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15
    ]


def _ibans(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _IBAN.finditer(text)
        if 15 <= len(plain := m[0].replace(" ", "")) <= 34 and mod97(plain)
    ]


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's first score, a step up for each near word for it, a step down for each against."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = set(_WORD.findall(near.lower()))
    good, bad = CONTEXT_WORDS[kind]
    value = START_SCORE[kind] + CONTEXT_STEP * (len(words & good) - len(words & bad))
    return min(1.0, max(0.0, round(value, 6)))


def find_spans(text: str | None) -> list[Span]:
    """(kind, start, end, score) by start, then by kind as listed; ends are exclusive."""
    if not text:
        return []
    found = []
    for order, kind in enumerate(KINDS):
        for start, end in _FINDERS[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE_KINDS or value >= KEEP_SCORE:
                found.append((start, order, kind, end, value))
    return [(kind, start, end, value) for start, _, kind, end, value in sorted(found)]


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``[KIND]``."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find_spans(x)]
            for x in batch.column(1).to_pylist()
        ]
        return pa.record_batch([batch.column(0), pa.array(spans, _SPAN_TYPE)], ["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    found = map_text(source, "text", run, f"key {kind}, spans {_SPANS}")
    return found.withColumnRenamed("key", key)


def masked_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``length``, where present, counted anew."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            field = batch.schema.field(at)
            for part in text_slices(batch, text):
                texts = [x if x is None else mask(x, find_spans(x)) for x in part.column(at).to_pylist()]
                yield part.set_column(at, field, pa.array(texts, field.type))
        free_memory()

    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.coalesce(F.length(text).cast(kind), F.col(length)))
    return out


def joined_spans(spans: str, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of ``kinds``, joined by commas."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(
            kept,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = personal_data(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined_spans("spans", BASE_KINDS), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
        count("iban").alias("n_iban"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
