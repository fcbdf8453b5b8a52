"""Secret scan with corpus-wide ownership frequency.

A scan finds candidate spans in whole texts: assignments, access keys and hex
runs by fixed patterns (always kept), and long mixed tokens as a high-recall
addition.  The hash of every candidate value is counted over the corpus: in how
many repositories (documents) and by how many owners it occurs.  Values that many
owners share are copied examples; values of one owner in few repositories look
live.  Counts are aggregated per (value, owner) first, so a value that a third of
the corpus repeats is combined before it is shuffled.

Null and empty texts have no span.  A null owner counts as one owner of its own
name.  Repeated rows are separate repositories.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import free, keyed, stored, told_apart

#: Base patterns in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "live")

#: A value is live-looking up to this many owners and repositories.
MAX_OWNERS = 1
MAX_REPOS = 3
#: Bits per character of a mixed token, which may have any length.
MIN_ENTROPY = 3.5


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in (token.count(x) for x in set(token)))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of the base patterns, by start then kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), m[2]))
    for m in ACCESS.finditer(text):
        if len(m[0]) >= 16:
            found.append((m.start(), 1, m.end(), m[0]))
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def mixed_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of mixed letters and digits with high entropy outside ``taken``."""
    out, k = [], 0
    ends = sorted((s, e) for s, _, e, _ in taken)
    for m in MIXED.finditer(text):
        s, e = m.span()
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        if any(a < e and s < b for a, b in ends[k:k + 4]):
            continue
        t = m[0]
        if any(c.isdigit() for c in t) and any(c.isupper() for c in t) and any(c.islower() for c in t) and entropy(t) >= MIN_ENTROPY:
            out.append((s, 3, e, t))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("first", pa.bool_())])
_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:binary,first:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py() or ""
            base = base_spans(text)
            seen: set[bytes] = set()
            spans = []
            for s, k, e, value in base + mixed_spans(text, base):
                h = xxhash.xxh3_128_digest(value.encode())
                spans.append({"start": s, "kind": k, "end": e, "value": h, "first": h not in seen})
                seen.add(h)
            rows.append(spans)
        yield pa.record_batch(
            [batch.column("rid"), batch.column("id"), batch.column("owner"), pa.array(rows, pa.list_(_SPAN))],
            ["rid", "id", "owner", "spans"],
        )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per document: ``rid, id, spans``.

    ``spans`` holds ``start, kind, end, owners, repos, live`` in order of start and
    kind: every base span, and the added tokens that look live.
    """
    given = keyed(docs, id_col, text=docs[text_col].cast("string"), owner=docs[owner_col].cast("string"))
    kind = dict(given.dtypes)["id"]
    rows = given.select("rid", "id", F.coalesce("owner", F.lit("\0none")).alias("owner"), "text").mapInArrow(
        _scan, f"rid long, id {kind}, owner string, spans {_SPANS}"
    )
    scanned = stored(rows, "secret-scan")
    each = scanned.select("rid", "owner", F.explode("spans").alias("s")).select("rid", "owner", "s.*")
    counts = each.groupBy("value", "owner").agg(F.count_if("first").alias("repos")).groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")
    )
    judged = each.join(counts, "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    kept = judged.where("kind < 3 or live").groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("spans")
    )
    return scanned.select("rid", "id").join(kept, "rid", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(dict(kept.dtypes)["spans"]))
    )


def named(spans: str) -> F.Column:
    """``kind:start:end`` joined by commas, from an array of spans."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                   mask: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mask``; same columns.

    Widely copied examples stay.  Only texts with such a span are rewritten, and
    their ``length_col`` with them.  Every row is masked by its own spans, also where
    rows share an id or have none.
    """
    rows, key = told_apart(docs, id_col)
    found = scan_secrets(rows, key, text_col, owner_col)
    mark, own = free(rows, "live"), free(rows, "owner_id")
    live = found.select(F.col("id").alias(own), F.filter("spans", lambda s: s["live"]).alias(mark)).where(F.size(mark) > 0)
    held = rows.join(live, F.col(key) == F.col(own), "left")

    @F.pandas_udf("string")
    def masked(texts, spans):
        out = []
        for text, cut in zip(texts, spans):
            if text is None or cut is None:
                out.append(text)
                continue
            parts, at = [], 0
            for s in sorted(cut, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at:s["start"]], mask]
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        return type(texts)(out, dtype=object)

    text = F.when(F.col(mark).isNotNull(), masked(F.col(text_col), F.col(mark))).otherwise(F.col(text_col))
    new = held.withColumn(text_col, text)
    if length_col:
        new = new.withColumn(length_col, F.when(F.col(mark).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return new.select(*docs.columns)
