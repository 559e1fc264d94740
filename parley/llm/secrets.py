"""Secret scans with an incremental ledger of blobs.

Every version of a document is a path; its text is a blob named by its SHA-256. The ledger
is a folder of two Parquet tables: ``blobs`` has (blob_id, rules, spans), a row for each blob and scan with the
rules (kind and version) that the scan applied; ``paths`` has every (doc_id, blob_id) ever recorded. A scan applies to a blob only
those rules whose pair with it the ledger lacks, appends what it finds, and joins findings
back to every path that holds the blob. One row per unseen blob is chosen
by hash of its content; a text moves at most once, to the task that scans its blob. A rule with a new version is
scanned anew, it alone; findings of its older versions stay in the table and are no longer reported.

Spans are code-point offsets, end exclusive, written ``kind:start:end``. The base kinds are
``assign``, ``access`` and ``hex`` (leftmost, non-overlapping per kind, the failing matches
dropped after matching). The rule set adds private keys (header, body and footer), prefixed service tokens,
web tokens and connection strings with a password.

Defined results: null text is the empty blob, which has no spans; repeated rows each come
back with the blob's spans; null ids are kept; an empty table gives no rows; a blob is
scanned whole whatever its length; extra columns are ignored by ``findings`` and kept by
``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm._shared import documents, fresh, materialise, new_path, write

BASE = ("assign", "access", "hex")
#: A private key from its header to the matching footer; without one, through the base64 that follows (a short last line has a line of its own).
PEM = re.compile(
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])+(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=:@])))+(?:(?:\s*\n\s*|\\n)[A-Za-z0-9+/]{1,15}={0,2}(?=\s*(?:\n|\Z)))?)?"
)
#: kind -> (pattern, group whose length counts, least length). Order is the order of kinds.
RULES: dict[str, tuple[re.Pattern[str], int, int]] = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
    "pem": (PEM, 0, 0),
    "prefixed": (re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,})"), 0, 0),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0),
    "dsn": (re.compile(r"\b[a-z][a-z0-9+]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@"), 0, 0),
}
#: Version of each rule; to be raised with its pattern.
VERSIONS = dict.fromkeys(RULES, "1") | {"pem": "2"}
FEW = 5_000  # unseen blobs (40 bytes each) up to which they are broadcast, so that a small update shuffles no texts
LEDGER = "blob_id binary, rules array<string>, spans string"
DIGEST = "blob_id binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def current() -> list[str]:
    """The rules in force, as the ledger names them."""
    return [f"{kind}@{VERSIONS[kind]}" for kind in RULES]


def scan(text: str, kinds: list[str] | None = None) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, rank of kind, end), of some kinds or all."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        for m in pattern.finditer(text) if kinds is None or kind in kinds else ():
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end()))
    found.sort()
    return found


def written(found: list[tuple[int, int, str]]) -> str:
    names = list(RULES)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)


def digest(found: list[tuple[int, int, str]]) -> tuple[int, int, int, str, str]:
    base = [x for x in found if x[1] < len(BASE)]
    return (*(sum(k == i for _, k, _ in base) for i in range(len(BASE))), hashlib.sha256(written(base).encode()).hexdigest(), written(found))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = batch.column("missing").to_pylist()
        spans = [written(scan(t or "", [x.rpartition("@")[0] for x in r])) for t, r in zip(batch.column("text").to_pylist(), rules, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("blob_id"), pa.array(rules, pa.list_(pa.string())), pa.array(spans, pa.string())], names=["blob_id", "rules", "spans"])


def _digest_batches(rules: list[str]):
    """Findings of blobs by the rules in force, whichever scans they came from."""
    rank = {kind: i for i, kind in enumerate(RULES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scans in batch.column("scans").to_pylist():
                found = set()
                for x in scans:
                    kinds = {r.rpartition("@")[0] for r in x["rules"] if r in rules}
                    for kind, a, b in (y.split(":") for y in x["spans"].split(",") if y):
                        if kind in kinds:
                            found.add((int(a), rank[kind], int(b)))
                rows.append(digest(sorted(found)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("blob_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[x.split()[0] for x in DIGEST.split(", ")])

    return run


def blob_id() -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return None


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The blobs of the ledger at ``path``; none where nothing has been written yet."""
    schema = T._parse_datatype_string(LEDGER)
    found = _table(spark, f"{path}/blobs", schema)
    return spark.createDataFrame([], schema) if found is None else found


def update_ledger(docs: DataFrame, path: str) -> None:
    """Scan the blobs of ``docs`` by the rules that the ledger lacks for them; append what is found."""
    spark, rules = docs.sparkSession, F.array(*map(F.lit, current()))
    versions = docs.select("doc_id", "text", blob_id().alias("blob_id"))
    blobs = versions.select("doc_id", "blob_id").groupBy(F.col("blob_id").alias("b")).agg(F.min("doc_id").alias("f"))
    ledger = _table(spark, f"{path}/blobs", T._parse_datatype_string(LEDGER))
    if ledger is None:
        unseen = blobs.withColumn("missing", rules)
    else:
        had = ledger.groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("had"))
        unseen = blobs.join(had, F.col("b") == F.col("blob_id"), "left").withColumn("missing", F.array_except(rules, F.coalesce("had", F.array().cast("array<string>")))).where(F.size("missing") > 0)
    # The pair (blob, id) names one row to scan: a blob with many copies is no hot key here.
    chosen = materialise(unseen.select("b", "f", "missing"), "blobs")
    if chosen.limit(FEW + 1).count() <= FEW:
        chosen = F.broadcast(chosen)
    todo = versions.join(chosen, (F.col("blob_id") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("f")))
    write(todo.select("blob_id", "missing", "text").mapInArrow(_scan_batches, LEDGER).dropDuplicates(["blob_id"]), f"{path}/blobs", "append")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, n_assign, n_access, n_hex, base_sha256, spans): the ledger's findings by the rules in force."""
    scans = read_ledger(spark, path).groupBy("blob_id").agg(F.collect_list(F.struct("rules", "spans")).alias("scans"))
    return scans.mapInArrow(_digest_batches(current()), DIGEST)


def record_paths(docs: DataFrame, path: str) -> None:
    """Keep which blob each document holds now, beside all that it held before."""
    rows = docs.select("doc_id", blob_id().alias("blob_id")).distinct()
    had = _table(docs.sparkSession, f"{path}/paths", rows.schema)
    if had is not None:
        rows = rows.join(had.toDF("i", "b"), (F.col("blob_id") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_anti")
    write(rows, f"{path}/paths", "append")


def history(spark: SparkSession, path: str, doc_id: str = "long") -> DataFrame:
    """(doc_id, blob_id, spans) of every version that was recorded and holds a finding."""
    paths = _table(spark, f"{path}/paths", T._parse_datatype_string(f"doc_id {doc_id}, blob_id binary"))
    if paths is None:
        return spark.createDataFrame([], f"doc_id {doc_id}, blob_id binary, spans string")
    return paths.join(digests(spark, path).where("spans != ''").select("blob_id", "spans"), "blob_id").select("doc_id", "blob_id", "spans")


def findings(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row, through the ledger."""
    update_ledger(docs, path)
    return docs.select("doc_id", blob_id().alias("blob_id")).join(digests(docs.sparkSession, path), "blob_id", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _redact_batches(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if text and spans:
                    pieces, at = [], 0
                    for kind, a, b in sorted((x.split(":") for x in spans.split(",")), key=lambda x: (int(x[1]), -int(x[2]))):
                        if int(b) > at:
                            pieces += [text[at : max(at, int(a))], f"[{kind}]" if int(a) >= at else ""]
                            at = int(b)
                    text = "".join([*pieces, text[at:]])
                out.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns([column])

    return run


def redact(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns as they are.

    ``n_chars``, where present, is counted again.
    """
    update_ledger(docs, path)
    spans, own, blob = fresh(docs.columns, "spans_", "own_", "blob_")
    hits = digests(docs.sparkSession, path).where("spans != ''").select(F.col("blob_id").alias(blob), F.col("spans").alias(spans))
    rows = docs.withColumn(own, blob_id()).join(hits, F.col(own) == F.col(blob), "left").select(*docs.columns, spans)
    out = rows.mapInArrow(_redact_batches(spans), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. The ledger of this run starts empty, so every blob is scanned once."""
    return findings(documents(spark, sf_dir), new_path(spark, "ledger"))
