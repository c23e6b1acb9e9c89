"""Personal data in track texts by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, schemes and identifier cues; from each anchor a local parser walks to the
boundaries of the value and validates it. Network addresses and card numbers have no fixed anchor: runs of digits are theirs.
Every parser is linear in the text, whatever the text holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in report order, the first four are the base kinds
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
# Identifier cues and the kind of what follows them
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "passport": "account",
    "ssn": "account",
    "social security": "account",
    "token": "secret",
    "secret": "secret",
    "password": "secret",
    "api key": "secret",
    "api_key": "secret",
    "api-key": "secret",
    "apikey": "secret",
}
#: kinds that masking replaces
MASKED = ("email", "ip", "card", "phone", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_DIAL = re.compile(r"[ ().0-9-]*+")
_DIGIT = re.compile(r"[0-9]")
_ADDRESS = re.compile(r"[^\s<>\"'`]*+")
_AFTER_CUE = re.compile(r"(?:[ ]?(?:number|no|nr|id|key))?[\"']?[ .]{0,2}[:=#]?[ ]?[\"']?", re.I)
_VALUE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_/+-]|[ ](?=[0-9]))*+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_DIGITS_ONLY = str.maketrans("", "", " -")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(sign, (kind, 1))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def _lowered(text: str) -> str:
    """A copy of the same length in which cues are in lower case."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    domain = _DOMAIN.match(text, at + 1)
    if domain is None:
        return None
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if not _DIGIT.match(text, plus + 1):
        return None
    end = _DIAL.match(text, plus + 2).end()
    while end > plus + 2 and not ("0" <= text[end - 1] <= "9"):
        end -= 1
    digits = sum("0" <= c <= "9" for c in text[plus:end]) if end - plus < 1000 else len(_DIGIT.findall(text, plus, end))
    return (plus, end) if end >= plus + 4 and 10 <= digits <= 15 else None


def _url(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    start = colon
    while start > floor and colon - start < 12 and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-")):
        start -= 1
    end = _ADDRESS.match(text, colon + 3).end()
    while end > colon + 3 and text[end - 1] in ".,;:!?)]}":
        end -= 1
    host = text[colon + 3 : end].partition("/")[0]
    return (start, end) if start < colon and text[start].isalpha() and any(c.isalnum() for c in host) else None


def _iban_holds(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _identifier(text: str, after: int, kind: str) -> tuple[int, int] | None:
    start = _AFTER_CUE.match(text, after).end()
    if kind == "iban":
        value = _IBAN.match(text, start)
        if value is None:
            return None
        for end in range(value.end(), start + 14, -1):  # the check digits tell where it ends
            if text[end - 1] != " " and _iban_holds(text[start:end]):
                return start, end
        return None
    value = _VALUE.match(text, start)
    if value is None:
        return None
    digits = len(_DIGIT.findall(text, start, value.end()))
    whole = value.end() - start
    return (start, value.end()) if (digits >= 6 if kind == "account" else whole >= 12 and digits >= 3) else None


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` in code points, by start and then kind."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    for place, (kind, length) in _ANCHORS.iter(_lowered(text)):
        if kind == "at":
            span = _email(text, place, out["email"][-1][1] if out["email"] else 0)
        elif kind == "plus":
            kind, span = "phone", _phone(text, place)
        elif kind == "scheme":
            kind, span = "url", _url(text, place - 2, out["url"][-1][1] if out["url"] else 0)
        else:
            cue = place + 1 - length
            word = cue > 0 and text[cue - 1].isalnum() or text[place + 1 : place + 2].isalnum()
            of = "account" if kind == "iban" else kind
            # a cue inside the last value starts none of its own, so no value is walked twice
            inside = out[of] and out[of][-1][1] > place + 1
            span = None if word or inside else _identifier(text, place + 1, kind)
            kind = of
        kind = "email" if kind == "at" else kind
        if span and not (out[kind] and out[kind][-1][1] > span[0]):
            out[kind].append(span)
    if _DIGIT.search(text):
        for m in _QUAD.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CHAIN.finditer(text):
            digits = m[0].translate(_DIGITS_ONLY)
            if _card(digits):
                out["card"].append(m.span())
            elif len(digits) > 19:  # numbers side by side: each group of digits may be one
                for part in re.finditer(r"[0-9]+", m[0]):
                    if _card(part[0]):
                        out["account"].append((m.start() + part.start(), m.start() + part.end()))
    found = [(start, kind, end) for kind, spans in out.items() for start, end in spans]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every masked span, joined where they overlap, replaced by the kind that starts first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if kind in MASKED:
            if start >= at:
                parts += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
    return "".join(parts) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.names.index("_text")
        spans, masked = [], []
        for text in batch.column(place):
            value = text.as_py()
            found = find_spans(value) if value else []
            spans.append([{"kind": k, "start": s, "end": e} for s, k, e in found])
            masked.append(mask(value, found) if found else value)
        columns = [batch.column(k) for k in range(batch.num_columns) if k != place]
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, _SPANS), pa.array(masked, pa.string())], names=names + ["spans", "masked"])


def personal_data(tracks: DataFrame, id_col: str = "track_id", text_col: str = "title", carry: tuple[str, ...] = ()) -> DataFrame:
    """Personal data in track texts: one row per row, in place, without a shuffle.

    Returns the id, the ``carry`` columns, ``spans`` (kind, start, end in code points, end exclusive; by start, then kind) and
    ``masked``, the text with personal spans replaced by ``<KIND>``. Base kinds are email, ip, card and phone, leftmost and not
    overlapping within a kind. The anchors add url (a scheme and its address; reported, not masked), account (IBAN with valid
    check digits, numbers behind a cue, card numbers inside longer digit chains) and secret (keys behind a cue, of any length).
    Cues count in any case, with or without a quote before the colon. Texts of any length are read whole, in linear time.

    A null text has no spans and stays null, an empty one stays empty. Ids are only passed on, so null and repeated ids are
    kept as they are. Columns that are neither named nor carried are dropped. An empty table gives no rows.
    """
    source = tracks.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)))
    spans = T.ArrayType(
        T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    )
    schema = T.StructType([f for f in source.schema if f.name != "_text"] + [T.StructField("spans", spans), T.StructField("masked", T.StringType())])
    back = [F.col("_id").alias(id_col), *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry))]
    return source.mapInArrow(_run, schema).select(*back, "spans", "masked")
