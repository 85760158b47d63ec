"""Secret scans: multipart credential linking.

Strong spans (assignments, access identifiers, long hex runs) are found by pattern. Weak parts -
user names, endpoints, short or unlabelled secrets - say little alone; they are reported only when
a complementary part stands near them in the same scope (a paragraph: text between blank lines).
The interval join of the parts is a pair of ordered windows within each scope: every part looks at
the nearest end before it and the nearest start after it of each class, which decides whether any
part of that class is within reach, without forming pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._store import id_value, materialize, texts

#: Kinds in the order in which ties at one start are listed; the first three are the strong ones.
KINDS = ["assign", "access", "hex", "weak", "identifier", "endpoint"]
STRONG = 3
#: Code points between two parts that still count as being together.
REACH = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK = re.compile(r"""(?:\b(?:pwd|pass|pin|auth|bearer|credential|private_key)["']?(?:\x20*+[:=]\x20++|\x20++)["']?[A-Za-z0-9+/_.=-]{4,})|(?<![A-Za-z0-9+/])(?=[a-z+/0-9]*[A-Z])(?=[A-Z+/0-9]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])""", re.A)
_IDENTIFIER = re.compile(r"""\b(?:user|username|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{2,}""", re.I | re.A)
_ENDPOINT = re.compile(r"""(?:https?|ftp|ssh|jdbc|postgres|mysql|mongodb|redis|s3)[a-z:]{0,32}://[^\s"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?![\d.])""", re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())]))
_SCHEMA = "key long, base array<struct<start:long,kind:int,end:long,scope:long>>, parts array<struct<start:long,kind:int,end:long,scope:long>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong spans."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the parts that mean something only together; none overlaps a strong span."""
    found = [(m.start(), kind, m.end()) for kind, pattern in ((3, _WEAK), (4, _IDENTIFIER), (5, _ENDPOINT)) for m in pattern.finditer(text)]
    kept, i, reach = [], 0, -1
    for x in sorted(found):
        while i < len(base) and base[i][0] < x[2]:
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= x[0]:
            kept.append(x)
    return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, parts = [], []
        for text in batch.column("text").to_pylist():
            strong = base_spans(text)
            weak = weak_parts(text, strong)
            if strong or weak:
                breaks = [m.start() for m in _BLANK.finditer(text)]
                scope = _scopes(breaks)
                strong = [(*x, scope(x[0])) for x in strong]
                weak = [(*x, scope(x[0])) for x in weak]
            base.append([dict(zip(("start", "kind", "end", "scope"), x, strict=True)) for x in strong])
            parts.append([dict(zip(("start", "kind", "end", "scope"), x, strict=True)) for x in weak])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(base, _SPANS), pa.array(parts, _SPANS)], ["key", "base", "parts"])


def _scopes(breaks: list[int]):
    from bisect import bisect_right

    return lambda start: bisect_right(breaks, start)


def _linked(found: DataFrame, reach: int) -> DataFrame:
    """(row, start, kind, end, with_kind, with_start, with_end) of the weak parts with a complementary part within reach in their own row: the nearest, of equally near ones the one before."""
    part = F.explode(F.concat("base", "parts")).alias("p")
    rows = found.where(F.size("parts") > 0).select("row", part).select("row", "p.*")
    # 0: something secret, 1: who, 2: where
    rows = rows.withColumn("cls", F.when(F.col("kind") == 4, 1).when(F.col("kind") == 5, 2).when(F.col("kind") == 1, 1).otherwise(0))
    scope = Window.partitionBy("row", "scope").orderBy("start", "kind", "end")
    before, after = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)

    def near(cls: int) -> tuple[Column, Column]:
        own = F.col("cls") == cls
        last = F.max(F.when(own, F.struct("end", "start", "kind"))).over(before)
        first = F.min(F.when(own, F.struct("start", "end", "kind"))).over(after)
        gaps = F.col("start") - last["end"], first["start"] - F.col("end")
        return tuple(F.when(gap <= reach, F.struct(F.when(gap > 0, gap).otherwise(0).alias("gap"), F.lit(i).alias("side"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))) for i, (gap, x) in enumerate(zip(gaps, (last, first), strict=True)))

    secret, who, where = (near(cls) for cls in (0, 1, 2))
    rows = rows.withColumn("partner", F.when(F.col("cls") == 0, F.least(*who, *where)).otherwise(F.least(*secret)))
    rows = rows.where((F.col("kind") >= STRONG) & F.col("partner").isNotNull())
    return rows.select("row", "start", "kind", "end", F.col("partner.kind").alias("with_kind"), F.col("partner.start").alias("with_start"), F.col("partner.end").alias("with_end"))


def _shown(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1), start.cast("string"), end.cast("string"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: _shown(s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id, ``base`` and ``linked`` (arrays of start, kind, end in code points), and
    ``links``: each linked span again, with the kind, start and end of the part that completes it.

    A null text is empty and has no spans; a null id stays null. Rows are numbered when their spans
    are written, and parts link within their row only, so rows that share an id, or repeat, each have
    the spans of their own text. Of spans with one start the kinds' order decides. An empty table
    gives an empty table.
    """
    found = texts(docs, id_col, text_col).mapInArrow(_scan, _SCHEMA)
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "credentials")
    linked = _linked(found, reach).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "with_kind", "with_start", "with_end"))).alias("links"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,with_kind:int,with_start:long,with_end:long>>")
    out = found.join(linked, "row", "left").select(id_value("key").alias(id_col), plain.alias("base"), F.coalesce("links", none).alias("links"))
    return out.select(id_col, "base", F.transform("links", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("linked"), "links")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``scan``'s rows: counts of each base kind, a hash of the base spans, all spans as text, and what completes
    which, as span>span; no spans give empty texts."""
    completed = F.transform("links", lambda s: F.concat_ws(">", _shown(s["kind"], s["start"], s["end"]), _shown(s["with_kind"], s["with_start"], s["with_end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
        F.array_join(completed, ",").alias("links"),
    )
