"""Versioned datasets in a folder: Parquet rows, JSON beside them, versions never overwritten."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..errors import IngestError
from ..operators.labels import Labels
from ..sources.readers import ingest, pick_table
from ..sources.sniff import Limits
from .clean import ROW_ID, clean, normalize_labels
from .context import Context
from .insights import executive_summary, generate, plan_dashboard
from .profile import Profile, profile
from .quality import quality
from .transformations import decisions, transformations


@dataclass
class Options:
    """Choices of one version; a change makes a new version from the original file."""

    table: str | None = None
    exclude: tuple[str, ...] = ()
    merge_labels: tuple[str, ...] = ()
    remove_duplicates: bool = False
    date_orders: dict[str, str] = field(default_factory=dict)


class Store:
    """Datasets under one root path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits()) -> None:
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits

    # small JSON files beside the data, written and read by Spark itself

    def _put(self, path: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{path}")

    def _get(self, path: str) -> dict:
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/{path}").collect()))

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")

    def create(self, source: str, name: str | None = None, options: Options | None = None) -> str:
        """Ingest a file as version 1; returns the dataset's id."""
        dataset = uuid.uuid4().hex[:12]
        self._process(dataset, 1, source, options or Options(), name or source.rsplit("/", 1)[-1])
        return dataset

    def _process(self, dataset: str, version: int, source: str, options: Options, name: str) -> None:
        found = ingest(self.spark, source, self.limits)
        table = next((t for t in found.tables if t.name == options.table), None) if options.table else pick_table(found.tables)
        if table is None:
            raise IngestError("no_table", f"There is no table {options.table!r}.")
        cleaned = clean(table.df, date_orders=options.date_orders)
        df = cleaned.df.drop(*options.exclude)
        for column in options.merge_labels:
            df = normalize_labels(df, column)
        if options.remove_duplicates:
            from ..operators.explorer import drop_duplicate_rows

            df = drop_duplicate_rows(df, [ROW_ID])
        folder = f"dataset={dataset}/version={version}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{folder}/rows")
        rows = self.rows(dataset, version)
        found_profile = profile(rows, cleaned.meta)
        labels = Labels.build(rows, f"{self.root}/{folder}/labels", [c.name for c in found_profile.columns.values() if c.kind == "string"])
        ctx = Context(rows, found_profile, labels=labels)
        insights = generate(ctx)
        report = quality(found_profile, cleaned.suggestions, cleaned.meta, date.today())
        merged = [(c, next((s["labels"] for s in cleaned.suggestions if s["kind"] == "normalize_labels" and s["column"] == c), 0)) for c in options.merge_labels]
        steps = transformations(cleaned, merged=merged, duplicates=cleaned.n_rows - found_profile.n_rows, dropped=options.exclude)
        info = {
            "name": name, "source": source, "format": found.format, "options": asdict(options), "warnings": found.warnings, "log": cleaned.log, "transformations": steps, "suggestions": decisions(cleaned, report), "n_rows": ctx.profile.n_rows,
            "meta": {k: asdict(m) for k, m in cleaned.meta.items()}, "quality": report, "insights": [asdict(i) for i in insights], "summary": executive_summary(insights), "dashboard": plan_dashboard(ctx), "created": time.time(),
        }
        self._put(f"{folder}/info", info)
        self._put(f"dataset={dataset}/current", {"version": version})

    def rows(self, dataset: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/dataset={dataset}/version={version or self.current(dataset)}/rows")

    def labels(self, dataset: str, version: int | None = None) -> Labels | None:
        """The dictionary of a version's labels; versions written before there was one have none."""
        folder = f"dataset={dataset}/version={version or self.current(dataset)}/labels"
        return Labels.read(self.spark, f"{self.root}/{folder}") if self._fs().exists(self._path(folder)) else None

    def info(self, dataset: str, version: int | None = None) -> dict:
        return self._get(f"dataset={dataset}/version={version or self.current(dataset)}/info")

    def current(self, dataset: str) -> int:
        return self._get(f"dataset={dataset}/current")["version"]

    def versions(self, dataset: str) -> list[int]:
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self._fs().listStatus(self._path(f"dataset={dataset}")) if s.getPath().getName().startswith("version="))

    def list(self) -> list[dict]:
        """id, name, rows and quality of every dataset."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        ids = sorted(s.getPath().getName().split("=")[1] for s in fs.listStatus(self._path("")) if s.getPath().getName().startswith("dataset="))
        return [{"id": i, "name": (info := self.info(i))["name"], "rows": info["n_rows"], "quality": info["quality"]["score"], "version": self.current(i)} for i in ids]

    def reprocess(self, dataset: str, options: Options) -> int:
        """A new version from the original file; earlier ones stay."""
        info, version = self.info(dataset), max(self.versions(dataset)) + 1
        self._process(dataset, version, info["source"], options, info["name"])
        return version

    def activate(self, dataset: str, version: int) -> None:
        if version not in self.versions(dataset):
            raise IngestError("unknown_version", f"There is no version {version}.")
        self._put(f"dataset={dataset}/current", {"version": version})

    def delete(self, dataset: str) -> None:
        self._fs().delete(self._path(f"dataset={dataset}"), True)

    def save_dashboard(self, dataset: str, name: str, plan: dict) -> None:
        """Widgets' tools and arguments; never data."""
        self._put(f"dataset={dataset}/dashboards/{name}", {"widgets": plan["widgets"], "filters": plan.get("filters", [])})

    def dashboard(self, dataset: str, name: str) -> dict:
        return self._get(f"dataset={dataset}/dashboards/{name}")

    def context(self, dataset: str, version: int | None = None) -> Context:
        from .clean import ColumnMeta

        df, info = self.rows(dataset, version), self.info(dataset, version)
        return Context(df, self._profile(df, {k: ColumnMeta(**m) for k, m in info["meta"].items()}), labels=self.labels(dataset, version))

    @staticmethod
    def _profile(df: DataFrame, meta: dict) -> Profile:
        return profile(df, {k: m for k, m in meta.items() if k in df.columns})
