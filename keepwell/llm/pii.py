"""Operator 5: personal data. Patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from keepwell.llm.common import text_blocks

#: The kinds in the order of the report, their patterns, and the words that speak for them.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ["mail", "email", "contact", "write"],
    "ip": ["ip", "address", "server", "host"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "transfer"],
    "ssn": ["ssn", "social", "security"],
}
#: Score of a span by its pattern and validator alone, what a context word adds, and how far it may be.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.4}
CONTEXT_BONUS, CONTEXT_CHARACTERS, KEEP_SCORE = 0.3, 40, 0.5
_LOCAL_CLASS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    numbers = [ord(c) - 48 for c in digits[::-1]]
    return (sum(numbers[::2]) + sum(_DOUBLED[n] for n in numbers[1::2])) % 10 == 0


def mod97(code: str) -> bool:
    """Does an account code pass its check? Letters count as 10 to 35, the first four characters go to the end."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Addresses, leftmost first. Only the surroundings of each @ are read, so long runs cost no more than their length."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CLASS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def accounts(text: str):
    """Account codes that pass their check, leftmost first; where the longest proposal fails, each shorter one that ends with a
    group of characters is tried, then the next start."""
    found = IBAN.search(text)
    while found:
        start, at = found.start(), found.start() + 1
        for end in [found.end(), *(start + m.start() for m in reversed([*re.finditer(" ", found[0])]))]:
            code = text[start:end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield start, end
                at = end
                break
        found = IBAN.search(text, at)


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def context(text: str, kind: str, start: int, end: int) -> bool:
    near = f"{text[max(0, start - CONTEXT_CHARACTERS):start]} {text[end:end + CONTEXT_CHARACTERS]}".lower()
    return any(word in CONTEXT[kind] for word in re.findall(r"[a-z]+", near))


def find(text: str) -> list[Span]:
    """All spans of a text by kind, then start: (kind, start, end, score), in code points, end exclusive.

    The first four kinds follow their pattern and check alone and always stay. The added kinds (account codes that pass
    mod 97, social security numbers) need a score of at least KEEP_SCORE and overlap no span of the first four.
    """
    hits = [("email", s, e) for s, e in emails(text)]
    has_digit = re.search("[0-9]", text)
    if has_digit:
        hits += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                hits.append(("card", *m.span()))
        hits += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        base = sorted((s, e) for _, s, e in hits)
        more = [("iban", s, e) for s, e in accounts(text)]
        more += [("ssn", *m.span()) for m in SSN.finditer(text)]
        hits += [(k, s, e) for k, s, e in more if not any(a < e and s < b for a, b in base)]
    spans = [(k, s, e, min(1.0, BASE_SCORE[k] + CONTEXT_BONUS * context(text, k, s, e))) for k, s, e in hits]
    return [x for x in spans if x[0] in KINDS[:4] or x[3] >= KEEP_SCORE]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first that starts is named."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores array<double>, masked of every row.

    Null and empty texts have no spans (`masked` is null for null). Repeated rows give a row each; other columns are ignored.
    """

    def run(batches):
        for block in text_blocks(batches):
            texts = block.column("text").to_pylist()
            found = [find(t or "") for t in texts]
            base = [[x for x in spans if x[0] in KINDS[:4]] for spans in found]
            yield pa.record_batch([
                block.column("doc_id"),
                *(pa.array([sum(x[0] == kind for x in spans) for spans in base], pa.int64()) for kind in KINDS[:4]),
                pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                pa.array([joined(spans) for spans in found], pa.string()),
                pa.array([[x[3] for x in spans] for spans in found], pa.list_(pa.float64())),
                pa.array([t and masked(t, s) for t, s in zip(texts, found, strict=True)], pa.string()),
            ], names)

    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "scores array<double>, masked string")
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask_documents(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked and, where the column exists, the length renewed."""
    schema = docs.schema
    at, long = docs.columns.index(text), docs.columns.index(size) if size in docs.columns else None

    def run(batches):
        for block in text_blocks(batches, text):
            texts = [t and masked(t, find(t)) for t in block.column(at).to_pylist()]
            columns = list(block.columns)
            columns[at] = pa.array(texts, pa.string())
            if long is not None:
                columns[long] = pa.array([None if t is None else len(t) for t in texts], block.schema.field(long).type)
            yield pa.record_batch(columns, names)

    names = docs.columns
    return docs.mapInArrow(run, schema)
