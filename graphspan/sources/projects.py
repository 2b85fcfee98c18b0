"""Whole projects parsed under a budget of lines and time, with one status for each.

Sizes come from one aggregation, so texts of projects beyond the budget are not
shuffled.  A project's files meet in one task and are parsed one after the other; what goes wrong in
one project, or takes too long, is its status and nobody else's.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .program import NODE_SCHEMA, module_rows, packed_rows, row_of

#: A row of this kind ends each project: status as value, the reason as name, parsed modules as pos, lines as line, rows as id.
STATUS = "Project"
STATUSES = ("ok", "error", "timeout", "too_big", "too_small")


@contextmanager
def limit_time(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in the block after so many seconds, wherever Python code runs (not in the middle of a compiled function); only in a main thread, as that of a worker."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def project_files(spark: SparkSession, folder: str, suffix: str = ".json", skip: list[str] | None = None) -> DataFrame:
    """project, path, text of the files with a suffix under the folders of `folder`, one folder for each project.

    Spark's reader lists and reads, so the folder may be in any store.  Paths that
    hold one of `skip` (such as /node_modules/) are left out.
    """
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for s in skip or []:
        named = named.where(~F.contains("path", F.lit(s)))
    root = F.lit(folder.rstrip("/").split("://", 1)[-1].split("/", 1)[-1])
    inner = F.ltrim(F.element_at(F.split("path", F.concat(F.lit("/"), F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), F.lit("/")), 2), 2))
    return named.select(F.element_at(F.split(inner, "/"), 1).alias("project"), "path", "text").where("project IS NOT NULL")


def parse_projects(files: DataFrame, most_lines: int | None = None, least_lines: int = 0, seconds: float | None = None) -> DataFrame:
    """Rows of all modules of files(project, path, text) and, for each project, a last row of kind Project.

    A project with more than most_lines or fewer than least_lines lines is not
    parsed (too_big, too_small); one that does not parse is an error with its file and reason, one
    that takes longer than `seconds` a timeout.  Only projects that are ok have
    other rows.  Null texts are empty files, which are no modules.
    """
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    sizes = files.groupBy(F.col("project").alias("p")).agg(F.sum(lines).cast("bigint").alias("lines"))
    status = F.when(F.col("lines") < least_lines, "too_small")
    status = status.when(F.col("lines") > most_lines, "too_big") if most_lines is not None else status
    judged = sizes.select("p", "lines", status.alias("status"))
    within = files.join(judged.where("status IS NULL"), F.col("project").eqNullSafe(F.col("p"))).select("project", "path", "text", "lines")
    # a fixed number of parts: texts are short for what parsing them takes, and would be put together to a few tasks
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = within.repartition(parts, "project").sortWithinPartitions("project", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for project, path, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now["project"] != project:
                    if now is not None:
                        yield ended(now)
                    now = {"project": project, "lines": n, "rows": [], "modules": 0, "status": "ok", "why": None, "left": seconds}
                if now["status"] == "ok":
                    parse(now, path, text or "")
        if now is not None:
            yield ended(now)

    def parse(now: dict, path: str, text: str) -> None:
        began = time.monotonic()
        try:
            with limit_time(now["left"]):
                now["rows"] += module_rows(now["project"], text)
            now["modules"] += 1
        except TimeoutError as e:
            now |= {"status": "timeout", "why": f"{path}: more than {seconds:g} s" if seconds is not None else str(e), "rows": []}
        except Exception as e:  # whatever a project's text does, it is that project's status
            now |= {"status": "error", "why": f"{path}: {type(e).__name__}: {e}", "rows": []}
        if now["left"] is not None:
            now["left"] = max(1e-3, now["left"] - (time.monotonic() - began))

    def ended(now: dict) -> pa.RecordBatch:
        last = row_of(project=now["project"], kind=STATUS, value=now["status"], name=now["why"], pos=now["modules"], line=now["lines"], id=len(now["rows"]))
        return packed_rows([*now["rows"], last])

    parsed = dealt.mapInArrow(run, NODE_SCHEMA)
    known = {"project": F.col("p"), "kind": F.lit(STATUS), "value": F.col("status"), "pos": F.lit(0), "line": F.col("lines").cast("int"), "id": F.lit(0)}
    rest = judged.where("status IS NOT NULL").select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in parsed.schema.fields])
    return parsed.unionByName(rest)


def statuses(rows: DataFrame) -> DataFrame:
    """project, status, reason, modules, lines, nodes: one row for each project of parse_projects."""
    return rows.where(F.col("kind") == STATUS).select("project", F.col("value").alias("status"), F.col("name").alias("reason"), F.col("pos").alias("modules"), F.col("line").alias("lines"), F.col("id").alias("nodes"))
