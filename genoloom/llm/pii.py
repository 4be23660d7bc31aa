"""Personal data: an Aho-Corasick pass finds anchors, deterministic local parsers expand and validate them.

Anchors are at-signs, digits, plus signs, schemes and cues of secrets and accounts. An email grows from its at-sign in
both directions, numbers from their first digit, phones from their plus sign. Kinds and their order: email, ip, card,
phone (the base kinds), then url (scheme with user data), iban, ssn, key and secret.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "key", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_USER = re.compile(r"://[A-Za-z0-9._%+-]+:[^\x00-\x20@/]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"AKIA[0-9A-Z]{8,}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?:password|passwd|token|secret|api_key)\x20?[=:]\x20?(?:\"([^\"\s]{6,})\"|([^\s\"]{6,}))", re.I | re.A)
_DIGITS = re.compile(r"[0-9]+")
#: The cues, each with the parser that its place goes to.
CUES = (
    ("@", "email"), ("+", "phone"), ("0", "digit"), ("1", "digit"), ("2", "digit"), ("3", "digit"), ("4", "digit"), ("5", "digit"),
    ("6", "digit"), ("7", "digit"), ("8", "digit"), ("9", "digit"), ("://", "url"), ("AKIA", "key"), ("password", "secret"),
    ("passwd", "secret"), ("token", "secret"), ("secret", "secret"), ("api_key", "secret"), ("IBAN", "iban"), ("SSN", "ssn"),
)
#: Cues of secrets are also known capitalised and in capitals.
CASES = (str.lower, str.capitalize, str.upper)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for cue, parser in CUES:
        for form in {f(cue) for f in CASES} if parser == "secret" else {cue}:
            a.add_word(form, (len(form), parser))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end exclusive; code points) of each kind, leftmost and non-overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    size = len(text)
    for last, (length, parser) in _automaton().iter(text):
        p = last - length + 1
        if parser == "digit":
            if p >= at["ip"]:
                m = _IP.match(text, p)
                # Without a match at a digit, none begins at the later digits of its run either.
                at["ip"] = (m or _DIGITS.match(text, p)).end()
                if m and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                    out["ip"].append(m.span())
            if p >= at["card"] and (m := _CARD.match(text, p)):
                at["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif parser == "email":
            start = p
            while start > at["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < p and (m := _DOMAIN.match(text, p + 1)):
                at["email"] = m.end()
                out["email"].append((start, m.end()))
        elif parser == "phone":
            if p >= at["phone"] and (m := _PHONE.match(text, p)):
                at["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif parser == "url":
            start = p
            while start > at["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < p and (m := _URL_USER.match(text, p)):
                at["url"] = m.end()
                out["url"].append((start, m.end()))
        elif parser == "key":
            if p >= at["key"] and not (p and text[p - 1].isalnum()) and (m := _KEY.match(text, p)):
                at["key"] = m.end()
                out["key"].append(m.span())
        elif parser == "secret":
            if p >= at["secret"] and not (p and text[p - 1].isalnum()) and (m := _SECRET.match(text, p)):
                at["secret"] = m.end()
                out["secret"].append(m.span(1) if m.group(1) else m.span(2))
        else:  # a named account: the number follows the cue at once, or after ':' or '#'
            q = p + length
            while q < size and q < p + length + 3 and text[q] in " :#":
                q += 1
            m = (_IBAN if parser == "iban" else _SSN).match(text, q)
            if m and q >= at[parser] and (parser == "ssn" or _iban_ok(m.group())):
                at[parser] = m.end()
                out[parser].append(m.span())
    return out


def redact(text: str, mask: str = "[{}]") -> str:
    """The text with every span replaced by its kind; where spans overlap, the one that starts first (then the longer) wins."""
    parts, at = [], 0
    for start, neg_end, kind in sorted((s, -e, k) for k, spans in find_spans(text).items() for s, e in spans):
        if start >= at:
            parts += [text[at:start], mask.format(kind.upper())]
            at = -neg_end
    return "".join(parts) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of whole texts, and the redacted text if asked for.

    The counts and base_sha256 are of the base kinds; ``spans`` lists kind:start:end of all kinds, in order of kind and
    start, and n_spans is their number. Null and empty texts have none. A kind's spans never overlap; spans of different
    kinds may. Repeated rows each have their own result row; a text of any length takes time in proportion to it; an empty
    table gives an empty result; other columns of docs are ignored.
    """
    fields = [docs.schema[id_col], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
    if with_redacted:
        fields.append(T.StructField("redacted", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b, rows = batch.slice(at, 256), []
                texts = b.column(1).to_pylist()
                for text in texts:
                    found = find_spans(text or "")
                    named = {k: ",".join(f"{k}:{s}:{e}" for s, e in v) for k, v in found.items() if v}
                    base = ",".join(named[k] for k in BASE_KINDS if k in named)
                    rows.append((*(len(found[k]) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(named[k] for k in KINDS if k in named), sum(map(len, found.values()))))
                cols = [b.column(0), *(pa.array([r[i] for r in rows], pa.string() if i in (4, 5) else pa.int64()) for i in range(7))]
                if with_redacted:
                    cols.append(pa.array([None if t is None else redact(t) for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))
