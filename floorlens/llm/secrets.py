"""Secret scans over an incremental blob ledger.

Every version of every text is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger has
one row per blob and rule version with the blob's findings. A scan hashes all texts, takes the blobs
that the ledger has not seen under the current rules, scans one copy of each, appends the result to
the ledger and joins the findings back to every row (path) that holds the blob. Only blobs with
findings take part in that join, and a blob that very many rows hold is not shuffled.
:func:`scan_stored` keeps the ledger between runs.

Defined results: a null text is the empty blob, which has no findings; repeated rows each get their
findings; an empty table gives no rows; other columns than the path column and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skewed_left_join

#: Kinds in the order in which ties of position are listed. The pattern, and what a match must have.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
#: Further kinds that the base does not count: private key blocks and three-part web tokens.
MORE_RULES = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
)
RULE_VERSION = hashlib.sha256("\n".join(f"{k} {p.pattern} {g} {n}" for k, p, g, n in RULES + MORE_RULES).encode()).hexdigest()[:16]

_ORDER = {k: i for i, (k, *_) in enumerate(RULES + MORE_RULES)}
_SPAN = "array<struct<kind:string,start:long,end:long>>"
LEDGER_SCHEMA = f"blob binary, rule_version string, spans {_SPAN}"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings in code points, by start, then kind as listed."""
    found = []
    for kind, pattern, group, least in RULES + MORE_RULES:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    found.sort(key=lambda x: (x[1], _ORDER[x[0]]))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t.as_py() or "")] for t in batch.column(1)]
        version = pa.array([RULE_VERSION] * len(spans), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), version, pa.array(spans, kind)], names=["blob", "rule_version", "spans"])


def blobs(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{path}`").alias("path"), text.alias("text"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("blob"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id") -> DataFrame:
    """Ledger rows of the blobs of ``docs`` that ``ledger`` lacks under the current rules."""
    held = blobs(docs, path)
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        held = held.join(seen, "blob", "left_anti")
    once = held.groupBy("blob").agg(F.first("text").alias("text"))
    return once.mapInArrow(_scan, LEDGER_SCHEMA)


def scan(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Findings per row of ``docs`` (columns path, blob, spans) and the ledger with its new rows."""
    fresh = materialise(scan_unseen(docs, ledger, path), "ledger")
    whole = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    hits = whole.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    slim = materialise(blobs(docs, path).select("path", "blob"), "paths")
    # A blob that many rows hold is hot; most hold none of the blobs with findings, and are not joined at all.
    counts = slim.groupBy("blob").agg(F.count(F.lit(1)).alias("__rows"))
    known = materialise(hits.join(counts, "blob"), "hits")
    found = skewed_left_join(slim, known, ["blob"])
    return found.select("path", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans")), whole


def scan_stored(docs: DataFrame, store: str, path: str = "doc_id") -> DataFrame:
    """:func:`scan` with a ledger kept at the path ``store``, to which the rows of unseen blobs are appended."""
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(store) if files.exists(folder) else None
    fresh = materialise(scan_unseen(docs, ledger, path), "ledger")
    fresh.write.mode("append").partitionBy("rule_version").parquet(store)
    return scan(docs, spark.read.schema(LEDGER_SCHEMA).parquet(store), path)[0]


def joined(spans):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans, per row."""
    base = F.filter("spans", lambda s: s["kind"].isin([k for k, *_ in RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind, *_ in RULES),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
