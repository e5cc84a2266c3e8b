"""Credentials of several parts, linked within scopes.

Strong kinds stand on their own: assigned values, access identifiers and long
hexadecimal runs. Weak kinds are a named account, an opaque token and an endpoint;
each is common in harmless text, so one is reported only when a complementary part
(identifier, secret, endpoint) lies in the same scope. A scope is a run of lines
without a blank one; parts are joined by their intervals in one ordered sweep, so a
scope of any size costs as much as its candidates.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tidemark.llm.common import fresh_name, slices, tidied

# The base patterns. Runs of access and hex are as long as they can get,
# so asking for the least length within the pattern finds the same runs.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

ACCOUNT = re.compile(
    r"""(?ai)\b(?:client_?id|access_?key_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20?[:=]\x20?["']?([A-Za-z0-9@._-]{3,})"""
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
SCHEME = string.ascii_letters + string.digits + "+.-"
FIRST = re.compile(r"(?ai)\b[a-z]")
REST = re.compile(r"""(?a)://[^\s"'<>]{4,}""")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
BASE = KINDS[:3]
PART = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
PARTNERS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


def _opaque(text: str) -> bool:
    """Upper case, lower case and digits in turn, as generated tokens have and words do not."""
    digits = sum(c.isdigit() for c in text)
    return 3 <= digits < len(text) - 5 and any(c.isupper() for c in text) and any(c.islower() for c in text)


def _endpoints(text: str) -> list[tuple[int, int]]:
    """Schemes of two characters or more before ``://``, however long, with what follows.

    From each mark the scheme's characters are walked back, no farther than the endpoint
    before, so the whole takes linear time.
    """
    found, done, mark = [], 0, text.find("://")
    while mark >= 0:
        rest = REST.match(text, mark)
        run = len(text[done:mark].rstrip(SCHEME)) + done
        first = FIRST.search(text, run, mark - 1)
        if rest and first:
            found.append((first.start(), rest.end()))
        done = rest.end() if rest and first else mark + 3
        mark = text.find("://", done)
    return found


def find_spans(text: str, reach: int | None = None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by start, then kind.

    Parts farther apart than the reach are not linked; with None, whole scopes are.
    """
    strong = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        strong += [("access", *m.span()) for m in ACCESS.finditer(text)]
    strong += [("hex", *m.span()) for m in HEX.finditer(text)]
    weak = [("account", *m.span()) for m in ACCOUNT.finditer(text)]
    weak += [("opaque", *m.span()) for m in OPAQUE.finditer(text) if _opaque(m[0])]
    if "://" in text:
        weak += [("endpoint", *span) for span in _endpoints(text)]
    if weak:
        strong += _linked(text, strong, weak, reach)
    return sorted(strong, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _linked(text: str, strong: list, weak: list, reach: int | None) -> list:
    """The weak spans with a complementary part in their scope and, if there is one, reach."""
    taken = sorted((start, end) for _, start, end in strong)
    starts, ends = [s for s, _ in taken], []
    for _, end in taken:
        ends.append(max(end, ends[-1] if ends else 0))
    free = []
    for span in weak:  # what a strong span covers is reported already
        at = bisect_left(starts, span[2])
        if not at or ends[at - 1] <= span[1]:
            free.append(span)
    bounds = [m.start() for m in BLANK.finditer(text)]
    parts: dict[str, list[tuple[int, int]]] = {"identifier": [], "secret": [], "endpoint": []}
    for kind, start, end in sorted(strong + free, key=lambda s: s[1:]):
        parts[PART[kind]].append((start, end))
    firsts = {name: [s for s, _ in spans] for name, spans in parts.items()}
    lasts = {name: sorted(e for _, e in spans) for name, spans in parts.items()}

    def near(part: str, start: int, end: int) -> bool:
        scope = bisect_right(bounds, start)
        low = bounds[scope - 1] if scope else 0
        high = bounds[scope] if scope < len(bounds) else len(text)
        if reach is not None:
            low, high = max(start - reach, low), min(end + reach, high)
        # intervals that reach into it are those that neither end before it nor start behind it
        return bisect_left(firsts[part], high) - bisect_right(lasts[part], low) > 0

    return [s for s in free if any(near(p, s[1], s[2]) for p in PARTNERS[PART[s[0]]])]


def _column(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def scan(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): its spans, an array of (kind, start, end).

    Nulls and empty texts have none. Repeated rows are scanned alike, other columns are not read.
    No rows give no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t, None)] for t in _column(batch)]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS.simpleString()}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of the first."""
    out, at, open_end = [], 0, -1
    for kind, start, end in spans:
        if start >= open_end:
            out += [text[at:start], f"[{kind}]"]
        at = open_end = max(end, open_end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns, secrets in ``text`` masked; a null text stays null, no rows stay none."""
    name = fresh_name(docs, "masked")
    schema = StructType([*docs.schema.fields]).add(name, StringType())

    def run(batches):
        for batch in slices(batches):
            plain = batch.column("text").to_pylist()
            done = [t if not t else masked(t, find_spans(t, None)) for t in plain]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidied(run), schema).withColumn("text", F.col(name)).drop(name)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
