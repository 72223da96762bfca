"""Secret scanning: single credentials by pattern, multipart ones by linking their parts.

Some strings are a secret on their own (``assign``, ``access``, ``hex``: the base
kinds, always reported). Others are weak: a 40-character mixed string may be a key
or a file name, a host name alone is no leak. Weak candidates are reported only
where complementary parts of a credential co-occur within a scope:

* ``key``      a 40-character mixed-case base64 string (a secret part), if no more than
               the scope lies between it and an access identifier (``access``);
* ``endpoint`` a URL or host:port, if no more than the scope lies between it and a
               secret part (``assign``, ``hex`` or a reported ``key``).

Texts are scanned for parts in one pass. The parts (few) are then interval-joined in
Spark: a text is cut into bins of the scope's width, a part lies in every bin it touches;
a bin keeps only the first start and the last end within it (pre-aggregated, so a text
full of parts makes no pairs), and a weak candidate is joined with the bins that it and
the scope on either side of it touch. Parts of a kind don't overlap, so there are no more
rows than bins and parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, slices, text_key, unused

#: Order of kinds at equal starts.
KINDS = ["assign", "access", "hex", "key", "endpoint"]
#: Most code points that may lie between parts that belong together.
SCOPE = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # AKIA[A-Z0-9]+ of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")  # [0-9a-f]+ of 32 characters or more
LONG = re.compile(r"[A-Za-z0-9/+]{32}")  # part of any hex or key
KEY = re.compile(r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
ENDPOINT = re.compile(r"""(?:https?|s3|wss?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|internal|local)(?::[0-9]{2,5})\b""", re.ASCII)


def find_parts(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, weak candidates) of a text as (kind, start, end)."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    weak = []
    if LONG.search(text):
        base += [("hex", *m.span()) for m in HEX.finditer(text)]
        for m in KEY.finditer(text):
            s = m.group()
            if re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s):
                weak.append(("key", *m.span()))
    if "://" in text or ":" in text:
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return base, weak


PART = "struct<kind:string,start:int,end:int>"
_PART = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [find_parts(t or "") for t in part.column("text").to_pylist()]
        as_rows = lambda xs: [[dict(zip(("kind", "start", "end"), x)) for x in spans] for spans in xs]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("_key"), pa.array(as_rows(b for b, _ in found), pa.list_(_PART)), pa.array(as_rows(w for _, w in found), pa.list_(_PART))],
            names=["doc_id", "_key", "base", "weak"])


def _link(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The weak candidates (_row, kind, start, end) with a part (_row, start, end) no more than the scope away.

    Interval join on (row, bin). A part is near enough if it starts by the candidate's end
    plus the scope and ends no earlier than its start minus the scope. Only the outermost
    bins hold parts that may fail, and only one of the two conditions each, so a bin's
    first start and last end tell whether any of its parts is near enough.
    """
    width = max(scope, 1)
    bin_of = lambda at: F.floor(at / width)
    touched = parts.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end") - 1))))
    bins = touched.groupBy("_row", "_bin").agg(F.min(F.greatest(F.col("start"), F.col("_bin") * width)).alias("_first"),
                                               F.max(F.least(F.col("end"), (F.col("_bin") + 1) * width)).alias("_last"))
    near = weak.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("start") - scope - 1), bin_of(F.col("end") + scope))))
    hit = near.join(bins, ["_row", "_bin"]).where((F.col("_first") <= F.col("end") + scope) & (F.col("_last") >= F.col("start") - scope))
    return hit.select("_row", "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, _key (of the text), base and spans (arrays of kind, start, end), one row per input row.

    Spans count code points, ends exclusive, ordered by start and kind. Null texts are
    empty, repeated rows get equal results, null ids are kept, no rows give no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared_folder(docs.sparkSession)
    found = rows.withColumn("_key", text_key(F.col("text"))).mapInArrow(
        _extract, f"doc_id bigint, _key binary, base array<{PART}>, weak array<{PART}>").checkpoint()  # texts are scanned once
    order = F.array(*[F.lit(k) for k in KINDS])
    # equal texts have equal spans: the parts are linked once per distinct text
    candidates = found.where(F.size("weak") > 0).select("_key", "base", "weak").dropDuplicates(["_key"])
    weak = candidates.select(F.col("_key").alias("_row"), F.explode("weak").alias("p")).select("_row", "p.*")
    strong = candidates.select(F.col("_key").alias("_row"), F.explode("base").alias("p")).select("_row", "p.*")
    keys = _link(weak.where("kind = 'key'"), strong.where("kind = 'access'"), scope)
    secret = strong.where("kind IN ('assign', 'hex')").unionByName(keys)
    ends = _link(weak.where("kind = 'endpoint'"), secret, scope)
    linked = keys.unionByName(ends).groupBy(F.col("_row").alias("_key")).agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("_linked"))  # spans of one text
    spans = F.concat("base", F.coalesce("_linked", F.array().cast(f"array<{PART}>")))
    ordered = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda p: F.struct(p.start.alias("start"), F.array_position(order, p.kind).alias("rank"), p.kind.alias("kind"), p.end.alias("end")))),
        lambda p: F.struct(p.kind.alias("kind"), p.start.alias("start"), p.end.alias("end")))
    final = found.where(F.size("weak") > 0).join(linked, "_key", "left").unionByName(found.where(F.size("weak") == 0), allowMissingColumns=True)
    return final.select("doc_id", "_key", ordered(F.col("base")).alias("base"), ordered(spans).alias("spans"))


def joined(spans) -> "F.Column":
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p.kind, p.start.cast("string"), p.end.cast("string"))), ",")


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text) for every row; see ``secret_spans``."""
    found = secret_spans(docs, scope)
    count = lambda kind: F.size(F.filter("base", lambda p: p.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every found span replaced by ``mark`` (overlapping spans by one); n_chars follows the text.

    All columns stay, whatever their names; rows without spans are untouched, null and
    empty texts among them. Equal texts, repeated rows too, are redacted alike, null ids
    are kept, and an empty table gives no rows.
    """
    key, found, merged = unused(docs, "_text_key", "_spans", "_merged")
    # equal texts have equal spans; the spans of a text are a few numbers
    spans = secret_spans(docs.select("doc_id", "text"), scope).where(F.size("spans") > 0).select(
        F.col("_key").alias(key), F.col("spans").alias(found)).dropDuplicates([key])
    ranges = F.aggregate(F.col(found), F.array().cast("array<struct<s:int,e:int>>"), lambda acc, p: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1).e >= p.start),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).s.alias("s"), F.greatest(F.element_at(acc, -1).e, p.end).alias("e"))))
    ).otherwise(F.concat(acc, F.array(F.struct(p.start.alias("s"), p.end.alias("e"))))))
    # what lies between the ranges: from the end of one (or 0) to the start of the next (or the text's end)
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda r: r.e))
    starts = F.concat(F.transform(merged, lambda r: r.s), F.array(F.length("text")))
    between = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: F.substring(F.col("text"), g.a + 1, g.b - g.a))
    out = docs.withColumn(key, text_key(F.col("text"))).join(spans, key, "left").withColumn(merged, ranges)
    some = F.col(found).isNotNull()
    out = out.withColumn("text", F.when(some, F.array_join(between, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
