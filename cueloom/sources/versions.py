"""Runs kept as they were, and rows replaced at once: folders that a manifest names.

What is written goes to a folder of its own first; then one small file, the next version of the manifest,
names the folders that count. Its name is taken by a rename that fails if another has it, so a reader sees the version
before or the one after, whatever happens in between, and of two writers one has to try again. Folders
that no version names are what a crash leaves; nothing reads them.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed the version."""


class Versions:
    """The manifests below a folder, numbered from 1."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = self._hadoop.Path(f"{self.root}/_versions")
        self._files = self._hadoop.FileContext.getFileContext(self._folder.toUri(), spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The last version; 0 if there is none."""
        if not self._files.util().exists(self._folder):
            return 0
        names = [s.getPath().getName() for s in self._files.util().listStatus(self._folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, version: int | None = None) -> dict[str, Any]:
        """The manifest of a version, or of the last; empty if there is none."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.root}/_versions/{version:08d}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def commit(self, after: int, manifest: dict[str, Any]) -> int:
        """Makes a manifest the version after ``after``; a Conflict if there is one."""
        version = after + 1
        draft, final = (self._hadoop.Path(f"{self.root}/_versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{version:08d}.json"))
        fs = self._folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        how = self.spark._sc._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._files.rename(draft, final, how)
        except Exception as error:
            fs.delete(draft, False)
            if self._files.util().exists(final):
                raise Conflict(f"version {version} is there already") from error
            raise
        return version

    def folder(self) -> str:
        """A fresh folder for data."""
        return f"{self.root}/data/{uuid.uuid4().hex}"


# Runs of a case: issues as they were found, by run.


def save_run(report: DataFrame, root: str, run_id: str, **about: Any) -> int:
    """A run's issues (rule, severity, ...) kept; the version that has it. A run of the same name is replaced
    where it stands among the others."""
    v = Versions(report.sparkSession, root)
    after, path = v.latest(), v.folder()
    report.write.parquet(path)
    now = v.read(after)
    runs = [r for r in now.get("runs", []) if r["run_id"] != run_id]
    at = next((k for k, r in enumerate(now.get("runs", [])) if r["run_id"] == run_id), len(runs))
    runs.insert(at, {"run_id": run_id, "folder": path, **about})
    return v.commit(after, {"baseline": now.get("baseline"), "latest": run_id, "runs": runs})


def set_baseline(spark: SparkSession, root: str, run_id: str) -> int:
    """Makes a run the one that others are compared with; that run's issues stay the baseline even if it is saved anew."""
    v = Versions(spark, root)
    after = v.latest()
    now = v.read(after)
    return v.commit(after, now | {"baseline": _run(now, run_id)})


def _run(manifest: dict[str, Any], run_id: str) -> dict[str, Any]:
    found = next((r for r in manifest.get("runs", []) if r["run_id"] == run_id), None)
    if found is None:
        raise KeyError(f"no run {run_id}")
    return found


def read_run(spark: SparkSession, root: str, run_id: str | None = None, version: int | None = None) -> DataFrame:
    """The issues of a run (None: of the last) as a version has them."""
    now = Versions(spark, root).read(version)
    return spark.read.parquet(_run(now, run_id or now.get("latest", ""))["folder"])


def read_baseline(spark: SparkSession, root: str) -> DataFrame | None:
    now = Versions(spark, root).read()
    return spark.read.parquet(now["baseline"]["folder"]) if now.get("baseline") else None


def previous_run(spark: SparkSession, root: str, run_id: str) -> str | None:
    """The run that was saved before another."""
    names = [r["run_id"] for r in Versions(spark, root).read().get("runs", [])]
    at = names.index(run_id) if run_id in names else 0
    return names[at - 1] if at else None


def overview(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(case, run_no, run_id, rule, severity, n, is_baseline, is_latest) of all runs of several cases (name: folder): what a
    dashboard shows. A run without issues has a row without rule."""
    rows, found = [], []
    for case, root in roots.items():
        now = Versions(spark, root).read()
        for no, run in enumerate(now.get("runs", []), 1):
            rows.append((case, no, run["run_id"], (now.get("baseline") or {}).get("run_id") == run["run_id"], now["latest"] == run["run_id"]))
            found.append(spark.read.parquet(run["folder"]).select(F.lit(case).alias("case"), F.lit(run["run_id"]).alias("run_id"), "rule", "severity"))
    runs = spark.createDataFrame(rows, "case string, run_no int, run_id string, is_baseline boolean, is_latest boolean")
    counts = spark.createDataFrame([], "case string, run_id string, rule string, severity string")
    for each in found:
        counts = counts.unionByName(each)
    counts = counts.groupBy("case", "run_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(counts, ["case", "run_id"], "left").select("case", "run_no", "run_id", "rule", "severity", F.coalesce("n", F.lit(0)).alias("n"), "is_baseline", "is_latest")


# A table of which rows are replaced by key: a folder for each value of a column with few values.

_PART = "_part"


def read_rows(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The table's rows as a version has them; None before the first."""
    parts = Versions(spark, root).read(version).get("parts", {})
    return spark.read.parquet(*parts.values()) if parts else None


def _replace(v: Versions, after: int, parts: dict[str, str], rows: DataFrame, part: Column, touched: list[str]) -> int:
    """Commits new folders for the touched parts; a part that is left without rows goes."""
    path = v.folder()
    rows.withColumn(_PART, part).write.partitionBy(_PART).parquet(path)
    try:
        written = {r[0] for r in v.spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).select(F.col(_PART).cast("string")).distinct().collect()}
    except PySparkException:  # no rows were written at all
        written = set()
    now = {k: f for k, f in parts.items() if k not in touched} | {k: f"{path}/{_PART}={k}" for k in written}
    return v.commit(after, {"parts": now})


def _part_of(column: str, parts: int) -> Column:
    """A part's name: by hash of a key, so that a part is never larger than its share and names need no escaping."""
    return F.concat(F.lit("p"), F.pmod(F.xxhash64(column), F.lit(parts)).cast("string"))


def upsert(rows: DataFrame, root: str, key: str, parts: int = 64) -> int:
    """Rows of a table replaced by those of equal key, others added; the new version. Only the parts that the
    rows' keys fall into are written again. Keys repeat neither in ``rows`` nor in the table, and ``parts`` stays
    what it was. Columns that either side lacks are null."""
    spark = rows.sparkSession
    v = Versions(spark, root)
    after = v.latest()
    named = v.read(after).get("parts", {})
    part = _part_of(key, parts)
    touched = [r[0] for r in rows.select(part).distinct().collect()]
    old = [named[t] for t in touched if t in named]
    kept = spark.read.parquet(*old).join(rows.select(key), key, "left_anti") if old else None
    return _replace(v, after, named, rows if kept is None else kept.unionByName(rows, allowMissingColumns=True), part, touched)


def delete(keys: DataFrame, root: str, key: str, parts: int = 64) -> int:
    """Rows with these keys gone; the new version. Keys that the table lacks change nothing."""
    spark = keys.sparkSession
    v = Versions(spark, root)
    after = v.latest()
    named = v.read(after).get("parts", {})
    part = _part_of(key, parts)
    touched = [t for t in (r[0] for r in keys.select(part).distinct().collect()) if t in named]
    if not touched:
        return after
    return _replace(v, after, named, spark.read.parquet(*(named[t] for t in touched)).join(keys.select(key), key, "left_anti"), part, touched)
