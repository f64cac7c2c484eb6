"""Secrets in texts: strong single patterns, and weak parts that count only where complementary parts stand together.

A scan finds the base kinds (reported on their own) and weak parts: access identifiers, secret keys and endpoints.
Weak parts are joined by interval inside their scope: a secret needs an identifier within ``reach`` characters, an
identifier needs a secret, an endpoint needs both. The join is a scan along the ordered parts of a scope that carries
the nearest part of each kind from either side, so a scope full of parts makes no pairs.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.spark_help import cut


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns.
_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")

# Weak parts: kinds "ident" (a run of 16 to 32 capitals and digits, both), "key" (a run of 32 to 128 base64 characters
# with a digit and either both cases or one of + and /) and "endpoint" (an address with a host).
IDENT = re.compile(r"[A-Z0-9]{16,}")
KEY = re.compile(r"[A-Za-z0-9+/]{32,}")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9][^\s\"'<>]*")
#: Lines with an empty one before or after start another scope.
SCOPE = re.compile(r"\n[ \t]*\n")
REACH = 400


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _is_ident(text: str, m: re.Match) -> bool:
    alone = not (text[m.start() - 1:m.start()].isalnum() or text[m.end():m.end() + 1].isalnum())
    return alone and len(m[0]) <= 32 and bool(re.search("[0-9]", m[0])) and bool(re.search("[A-Z]", m[0]))


def _is_key(run: str) -> bool:
    mixed = re.search("[a-z]", run) and re.search("[A-Z]", run) or "/" in run or "+" in run
    return len(run) <= 128 and bool(re.search("[0-9]", run)) and bool(mixed)


def weak_parts(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, scope) of identifiers, keys and endpoints."""
    found = [("ident", m.start(), m.end()) for m in IDENT.finditer(text) if _is_ident(text, m)]
    found += [("key", m.start(), m.end()) for m in KEY.finditer(text) if _is_key(m[0])]
    if "://" in text:
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if not found:
        return []
    borders = [m.end() for m in SCOPE.finditer(text)]
    found.sort(key=lambda s: s[1])
    out, scope = [], 0
    for kind, start, end in found:
        while scope < len(borders) and borders[scope] <= start:
            scope += 1
        out.append((kind, start, end, scope))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row (a number of its own), counts and digest of the base kinds, base spans, weak parts."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [t.as_py() or "" for t in part.column(2)]
                base = [base_spans(t) for t in texts]
                parts = [weak_parts(t) for t in texts]
                digest = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest() for s in base]
                counts = [pa.array([sum(k == kind for k, _, _ in s) for s in base], pa.int64()) for kind in KINDS[:3]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *counts, pa.array(digest),
                     pa.array([[dict(zip(("kind", "start", "end"), x)) for x in s] for s in base], pa.list_(_SPAN)),
                     pa.array([[dict(zip(("kind", "start", "end", "scope"), x)) for x in s] for s in parts], pa.list_(_PART))],
                    ["doc_id", "row", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])

    span = "array<struct<kind:string,start:bigint,end:bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        run, "doc_id bigint, row bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
             f"base {span}>>, parts {span},scope:bigint>>")


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of (row, kind, start, end, scope), the parts with their complement within ``reach`` in the same scope.

    Adds ident_at, key_at and endpoint_at: the nearest part of each kind, as evidence.
    """
    order = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    near = {}
    for kind in KINDS[3:]:
        own = F.col("kind") == kind
        last = F.last(F.when(own, F.struct("start", "end")), ignorenulls=True).over(before)
        first = F.first(F.when(own, F.struct("start", "end")), ignorenulls=True).over(after)
        # Distances; beyond reach where there is no such part on that side.
        back = F.when(last.isNull(), reach + 1).otherwise(F.greatest(F.col("start") - last["end"], F.lit(0)))
        ahead = F.when(first.isNull(), reach + 1).otherwise(F.greatest(first["start"] - F.col("end"), F.lit(0)))
        near[f"{kind}_at"] = F.when(F.least(back, ahead) <= reach, F.when(ahead < back, first["start"]).otherwise(last["start"]))
    linked = parts.withColumns(near)
    ident, key = F.col("ident_at").isNotNull(), F.col("key_at").isNotNull()
    return linked.where(ident & key)


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` is an array of (kind, start, end) in code points, by start, then kind: all base spans and the weak parts
    that stand with their complement. A null text counts as empty. A null or repeated doc_id is returned row by row.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    rows = cut(scan(docs))
    parts = rows.where(F.size("parts") > 1).select("row", F.inline("parts"))
    added = link_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))
    rank = F.array(*map(F.lit, KINDS))
    spans = F.concat(F.col("base"), F.coalesce("_added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"))))
    named = F.transform(ordered, lambda s: F.struct(
        F.element_at(rank, s["rank"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(added, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", named.alias("spans"))
