"""Secret scans with an incremental ledger of blobs.

Every version of a document is a blob, addressed by the SHA-256 of its text.
The ledger has one row per (blob, rule version) that has been scanned, with its
spans, findings or not.  A scan reads only blobs that the ledger lacks under the
present rule version, once each, and the findings are joined back to all
documents that have the blob.  A ledger is a folder of Parquet files that scans
append to, so the next scan, of these or of changed documents, reads new blobs only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_map import map_batches
from .common import cut, exists, likely_in, sealed, shared_folder

#: Raised whenever RULES change, so that old blobs are scanned again.
RULE_VERSION = 2
LEDGER_SCHEMA = "blob binary, rule_version int, spans array<struct<kind:string,start:int,end:int>>"

# The patterns of the base kinds, and public formats of well-known tokens.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_HINT = re.compile(r"assw|ecret|oken|api", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,40}PRIVATE KEY)-----")
#: What looks like the inside of a key: headers and long base64 lines, one shorter line at last; breaks may be escaped, as in JSON.
PEM_LINES = re.compile(r"(?:(?:\s|\\[rn])+(?:(?:Proc-Type|DEK-Info|Comment):[^\n\\]*|[A-Za-z0-9+/]{16,}={0,2}))*(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]{1,15}={0,2}(?=[ \t]*(?:[\r\n\\\"']|\Z)))?", re.ASCII)
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
SLACK = re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")
#: Parts of a JSON web token: three of 10 letters and more (the first after its head) with dots between.
JWT_HEAD, JWT_PART, JWT_LEAST = "eyJ", re.compile(r"[A-Za-z0-9_-]*"), 10


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Private keys from BEGIN to the END of the same kind that is the next mark; without it, to the end of the key-like lines."""
    marks = list(PEM.finditer(text))
    spans = []
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        if m[1] == "BEGIN":
            whole = after is not None and after[1] == "END" and after[2] == m[2]
            spans.append((m.start(), after.end() if whole else PEM_LINES.match(text, m.end()).end()))
    return spans


def jwt_spans(text: str) -> list[tuple[int, int]]:
    """JSON web tokens, leftmost first and without overlap.

    A head is only looked for once in a run of letters: a later one in the same
    run is followed by the same parts and has fewer letters of its own.
    """
    spans, at = [], text.find(JWT_HEAD)
    while at >= 0:
        first = JWT_PART.match(text, at).end()
        next_ = first
        if first - at >= len(JWT_HEAD) + JWT_LEAST and text.startswith(".", first):
            second = JWT_PART.match(text, first + 1).end()
            if second - first > JWT_LEAST and text.startswith(".", second):
                third = JWT_PART.match(text, second + 1).end()
                if third - second > JWT_LEAST:
                    spans.append((at, third))
                    next_ = third
        at = text.find(JWT_HEAD, next_)
    return spans


#: kind -> spans of a text.  The first three are the base kinds.
RULES: dict[str, Callable[[str], list[tuple[int, int]]]] = {
    "assign": lambda t: [m.span() for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 8] if ASSIGN_HINT.search(t) else [],
    "access": lambda t: [m.span() for m in ACCESS.finditer(t) if m.end() - m.start() >= 16],
    "hex": lambda t: [m.span() for m in HEX.finditer(t)],  # runs are maximal, so the limit can be part of the pattern
    "pem": lambda t: pem_spans(t) if "PRIVATE KEY-----" in t else [],
    "github": lambda t: [m.span() for m in GITHUB.finditer(t)] if "gh" in t else [],
    "slack": lambda t: [m.span() for m in SLACK.finditer(t)] if "xox" in t else [],
    "jwt": jwt_spans,
}
BASE_KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate(RULES)}


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of the rules."""
    found = [(kind, a, b) for kind, rule in RULES.items() for a, b in rule(text)]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with every span replaced by [kind]; spans that overlap become one."""
    out, at = [], 0
    for s in spans or []:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return text if not spans else "".join([*out, text[at:]])


def blob_of(text: Column) -> Column:
    """Content address; null and empty texts share one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_new_blobs(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows for the blobs of docs that the ledger lacks under RULE_VERSION."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("blob", blob_of(F.col("t")))
    unseen = rows.groupBy("blob").agg(F.min("id").alias("first_id"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    # ids and addresses are shuffled to find the first document of each blob; then each text at most once
    chosen = unseen.select(F.col("first_id"), F.col("blob").alias("first_blob")).hint("shuffle_hash")
    texts = rows.join(chosen, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("first_blob"))).select("blob", "t")

    def make():
        def work(batch):
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find_secrets(t)] for t in batch.column(1).to_pylist()]
            return {"blob": batch.column(0), "rule_version": [RULE_VERSION] * len(found), "spans": found}

        return work

    # documents that repeat an id and a text have sent their blob more than once
    return map_batches(texts, make, LEDGER_SCHEMA).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def fresh_ledger(spark: SparkSession) -> str:
    """The folder that the setting graphspan.secrets.ledger names, which later scans go on with; else a new one in the shared folder."""
    return spark.conf.get("graphspan.secrets.ledger", None) or f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of a ledger, or None if nothing was scanned yet."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder) if exists(spark, folder) else None


def extend_ledger(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans the blobs of docs that the ledger lacks, appends them, and returns known, spans for each blob of the ledger.

    Two scans at once may both add a blob: equal rows, of which one is returned.
    """
    spark = docs.sparkSession
    scan_new_blobs(docs, read_ledger(spark, folder), id_col, text_col).write.mode("append").parquet(folder)
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(folder).where(F.col("rule_version") == RULE_VERSION)
    return rows.groupBy(F.col("blob").alias("known")).agg(F.first("spans").alias("spans"))


def secret_spans(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, blob and spans (array of kind, start, end): one row per row of docs.

    Null texts count as empty and have no spans.  Offsets are code points, the end
    is exclusive; spans come by start, at one start in the order of RULES, so the
    result of equal texts is equal.  ledger: the folder of a ledger (default: that
    of fresh_ledger), whose blobs are not read again.  Repeated rows get the same
    spans; other columns of docs are ignored, whatever their names; an empty table
    gives no rows.  Texts are scanned whole, however long.
    """
    known = extend_ledger(docs, ledger or fresh_ledger(docs.sparkSession), id_col, text_col)
    paths = docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))
    return paths.join(known, F.col("blob") == F.col("known"), "left").select(F.col("id").alias(id_col), "blob", "spans")


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret in text_col replaced by its kind in brackets.

    Documents are joined to the findings of their blob; a bitmap of the blobs with
    findings lets most other texts stay where they are.  length_col, if docs has
    it, becomes the new length.  Null texts stay null, texts without secrets and
    all other columns as they are, whatever their names; repeated rows stay
    repeated; an empty table gives no rows.  ledger as in secret_spans.
    """
    columns = docs.columns
    known = extend_ledger(docs, ledger or fresh_ledger(docs.sparkSession), id_col, text_col)
    found = cut(known.where(F.size("spans") > 0).select(F.col("known").alias("found_blob"), F.xxhash64("known").alias("found_key"), F.col("spans").alias("found_spans")))
    rows = sealed(docs)
    text = columns.index(text_col)
    length = columns.index(length_col) if length_col in columns else None
    blob = blob_of(F.col(f"k{text}"))
    likely = likely_in(found, "found_key")(F.xxhash64(blob))
    joined = rows.where(likely).join(found.select("found_blob", "found_spans"), blob == F.col("found_blob"), "left").select(*rows.columns, "found_spans")

    def make():
        def work(batch):
            out = {f"k{i}": batch.column(i) for i in range(len(columns))}
            spans = batch.column(len(columns)).to_pylist()
            texts = [redact(t, s) for t, s in zip(batch.column(text).to_pylist(), spans, strict=True)]
            if length is not None:
                out[f"k{length}"] = [len(t) if s else n for t, s, n in zip(texts, spans, batch.column(length).to_pylist(), strict=True)]
            return out | {f"k{text}": texts}

        return work

    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return rows.where(~likely).unionByName(map_batches(joined, make, kinds)).toDF(*columns)
