"""Secret scan with multipart credential linking.

Each text is scanned once. Strong findings (``assign``, ``access``, ``hex``) stand alone. Weak parts (identifiers,
opaque strings, endpoints) prove nothing alone; they are exploded to rows, interval-joined with their complements
inside their scope (a paragraph) and kept only when a complementary part lies within ``reach`` code points of them or, where
that is None as in the registered query, anywhere in the scope.

Since the join only asks whether a complement is near, it is the nearest one before and after that decides; two window
functions over a text's parts find these, so no pair of parts is ever built.

Null and empty texts have no spans; very long ones are scanned whole, in linear time. Rows are keyed by an id of the row, not
by ``doc_id``: repeated rows and null ids are each reported. An empty table gives no rows. Columns of the input other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

# Fixed patterns of the base findings.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# Fixed patterns of the weak parts. Parts have any length; possessive quantifiers keep a scan of long runs linear.
IDENTIFIER = re.compile(r"""(?ai:\b(?:access_?key_?id|client_?id|account|user(?:name)?|login))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9@._-]{3,}+)""")
ENDPOINT = re.compile(r"(?a:\b(?:https?|ftp|ssh|amqps?|jdbc:[a-z0-9]{2,}+|postgres(?:ql)?|mysql|mongodb|redis)://[A-Za-z0-9._~:/@-]{3,}+)")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "opaque": "secret", "endpoint": "endpoint"}
STRONG = KINDS[:3]
#: A weak opaque string has at least this many bits a character, and letters as well as digits.
MIN_ENTROPY = 3.5
#: Complementary parts are at most this far apart, in code points, where a caller sets no other bound.
REACH = 400

PARTS = "array<struct<scope:long,start:long,end:long,kind:string>>"


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def find_parts(text: str) -> list[dict]:
    """All strong findings and weak parts of one text; offsets are code points, the end is exclusive."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 12]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    taken = sorted(spans)
    weak = [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    for m in OPAQUE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) >= MIN_ENTROPY:
            weak.append((m.start(), m.end(), "opaque"))
    # a weak part that overlaps a strong finding adds nothing
    k, furthest = 0, 0
    for a, b, kind in sorted(weak):
        while k < len(taken) and taken[k][0] < b:
            furthest = max(furthest, taken[k][1])
            k += 1
        if furthest <= a:
            spans.append((a, b, kind))
    if not spans:
        return []
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    found, scope, breaks = [], 0, (m.end() for m in BLANK_LINE.finditer(text))
    upcoming = next(breaks, None)
    for a, b, kind in spans:
        while upcoming is not None and upcoming <= a:
            scope, upcoming = scope + 1, next(breaks, None)
        found.append({"scope": scope, "start": a, "end": b, "kind": kind})
    return found


def secret_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``parts``: what each whole text holds, strong and weak alike."""
    kind = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [find_parts(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, PART_TYPE)], ["doc_id", "parts"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"doc_id {kind.simpleString()}, parts {PARTS}")


PART_TYPE = pa.list_(pa.struct([("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def link_parts(parts: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row for each text: its strong findings and the weak parts that a complementary part confirms.

    ``parts`` is a table of ``doc_id`` and ``parts`` as :func:`secret_parts` returns it. An identifier or an endpoint
    needs a secret within reach, a secret needs an identifier or an endpoint. Without ``reach`` the scope is the only bound.
    """
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    rows = (
        parts.withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.explode_outer("parts").alias("p"))
        .select("row", "doc_id", "p.*", roles[F.col("p.kind")].alias("role"))
    )
    order = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    secret, other = F.col("role") == "secret", F.col("role") != "secret"
    within = lambda gap: F.coalesce(gap.isNotNull() if reach is None else gap <= reach, F.lit(False))
    near = lambda cond: (
        within(F.col("start") - F.max(F.when(cond, F.col("end"))).over(before))
        | within(F.min(F.when(cond, F.col("start"))).over(after) - F.col("end"))
    )
    keep = F.col("kind").isin(*STRONG) | F.when(secret, near(other)).otherwise(near(secret))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "end", "kind")
    return (
        rows.withColumn("keep", keep)
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("keep"), span))).alias("spans"))
        .select("doc_id", "spans")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """Secrets of each text as ``spans`` (start, rank, end, kind), by start and then kind."""
    return link_parts(secret_parts(docs, id_col, text_col), reach)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.table(spark, sf_dir, "documents"), reach=None)
    strong = F.filter("spans", lambda s: s["rank"] <= len(STRONG))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, STRONG), F.sha2(joined(strong), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
