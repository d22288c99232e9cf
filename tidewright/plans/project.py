"""Projects: metadata, the registry of steps, their log, replay over a whole table."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import column_types, missing, recode, sampling

# fixed values
STEPS = ("INIT", "replace_mvs", "recode_types", "concat_with_init")
EXPORTED, ROLES, LOG_PROPERTIES = ("column_matches", "es_learned_settings", "infered_config"), ("source", "ref"), ("skipped", "completed", "error")
# end of fixed values


@dataclass(frozen=True)
class Step:
    """A transform (df, params) -> df, or an inference (df, params) -> params that feeds the step named by write_to."""

    func: Callable
    kind: str
    write_to: str
    full_run: bool = False


REGISTRY: dict[str, Step] = {
    "replace_mvs": Step(missing.replace, "transform", "replace_mvs", True),
    "recode_types": Step(lambda df, p: recode.recode(df, p["column_types"]), "transform", "recode_types", True),
    "infer_mvs": Step(lambda df, p: missing.params(missing.infer(df, [c for c in df.columns if c != "row_id" and "__" not in c], **p)), "infer", "replace_mvs"),
    "infer_types": Step(lambda df, p: column_types.infer(df, [c for c in df.columns if c != "row_id" and "__" not in c], **p), "infer", "recode_types"),
    "standard_sample": Step(lambda df, p: sampling.sample(df, "row_id", **p), "sample", ""),
}


class Project:
    """Metadata, parameters and logs of one table's steps as JSON files, replaced atomically."""

    def __init__(self, root: str, project_id: str | None = None, display_name: str = "", public: bool = False, description: str = ""):
        self.id = project_id or hashlib.md5(f"{time.time_ns()}{os.urandom(8).hex()}".encode()).hexdigest()
        self.path = os.path.join(root, self.id)
        os.makedirs(self.path, exist_ok=True)
        if not os.path.exists(os.path.join(self.path, "metadata.json")):
            now = time.time()
            self._write("metadata", {"project_id": self.id, "display_name": display_name, "public": public, "description": description, "timestamp": now, "last_used": now, "files": {}, "column_tracker": None, "has_mini": False, "log": {}})

    def _write(self, name: str, value) -> None:
        fd, draft = tempfile.mkstemp(dir=self.path)
        with os.fdopen(fd, "w") as f:
            json.dump(value, f, default=lambda x: sorted(x) if isinstance(x, set) else x.item() if hasattr(x, "item") else list(x))
        os.replace(draft, os.path.join(self.path, f"{name}.json"))

    def _read(self, name: str, default=None):
        p = os.path.join(self.path, f"{name}.json")
        if not os.path.exists(p):
            return default
        with open(p) as f:
            return json.load(f)

    @property
    def metadata(self) -> dict:
        return self._read("metadata")

    @contextlib.contextmanager
    def _locked(self, wait_s: float = 10.0):
        """One writer at a time: a lock file, waited for, and taken over when it is older than the wait."""
        lock, began = os.path.join(self.path, ".lock"), time.time()
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                with contextlib.suppress(FileNotFoundError):
                    if time.time() - max(began, os.path.getmtime(lock)) > wait_s:
                        os.remove(lock)
                time.sleep(0.02)
        try:
            yield
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(lock)

    def update(self, **values) -> None:
        with self._locked():
            self._write("metadata", self.metadata | values | {"last_used": time.time()})

    def delete(self) -> None:
        shutil.rmtree(self.path)

    def select(self, columns: list[str], original: list[str]) -> None:
        """Tracks the selected columns; when the selection grows, later steps have to run again."""
        if not columns or set(columns) - set(original):
            raise ValueError("the selection is a part of the table's columns and not empty")
        before = (self.metadata["column_tracker"] or {}).get("selected", [])
        self.update(column_tracker={"original": original, "selected": columns, "created": []})
        if set(columns) - set(before):
            self.clean_after("INIT")

    def params(self, step: str, value=None):
        if value is not None:
            self._write(f"params-{step}", value)
        return self._read(f"params-{step}", {})

    def log(self, step: str, **values) -> None:
        meta = self.metadata
        entry = {"module_name": step, "skipped": False, "completed": False, "written": False, "error": False} | meta["log"].get(step, {}) | values
        self.update(log=meta["log"] | {step: entry})

    def set_log_property(self, step: str, name: str, value: bool) -> None:
        if name not in LOG_PROPERTIES:
            raise ValueError(f"no property {name}")
        self.log(step, **{name: value})

    def last_written(self, before: str | None = None) -> str | None:
        """The latest step in order that is written without an error, ahead of a given one."""
        order = STEPS[: STEPS.index(before)] if before else STEPS
        log = self.metadata["log"]
        return next((s for s in reversed(order) if log.get(s, {}).get("written") and not log[s].get("error")), None)

    def clean_after(self, step: str) -> None:
        log = self.metadata["log"]
        self.update(log={s: v for s, v in log.items() if s not in STEPS or STEPS.index(s) <= STEPS.index(step)})

    def infer(self, name: str, df: DataFrame, params: dict | None = None) -> dict:
        step = REGISTRY[name]
        if step.kind != "infer":
            raise ValueError(f"{name} infers nothing")
        found = step.func(df, params or {})
        self.params(step.write_to, found)
        return found

    def transform(self, name: str, df: DataFrame, params: dict | None = None) -> DataFrame:
        """The step's result (a lazy plan) with the given or stored parameters; skipped steps give df itself."""
        if self.metadata["log"].get(name, {}).get("skipped"):
            return df
        start = time.time()
        out = REGISTRY[name].func(df, params or self.params(name))
        self.clean_after(name)
        self.log(name, written=True, completed=True, start_timestamp=start, end_timestamp=time.time())
        return out

    def run_all(self, df: DataFrame) -> DataFrame:
        """All steps of a full run, in order, with the stored parameters."""
        for name in STEPS:
            if name in REGISTRY and REGISTRY[name].full_run and self.params(name):
                df = self.transform(name, df)
        return df

    def export_config(self) -> dict:
        return {s: self.params(s) for s in STEPS if s != "INIT" and self.params(s)}

    def import_config(self, config: dict) -> None:
        for s, value in config.items():
            if s not in STEPS or s == "INIT":
                raise ValueError(f"no parameters for {s}")
            self.params(s, value)


def projects_table(spark, root: str) -> DataFrame:
    """Metadata of all projects below root."""
    rows = []
    for p in sorted(os.listdir(root)):
        meta = Project(root, p).metadata
        rows.append((meta["project_id"], meta["display_name"], meta["public"], meta["timestamp"], meta["last_used"], os.path.join(root, p)))
    return spark.createDataFrame(rows, "project_id string, display_name string, public boolean, created double, last_used double, path string")


def by_access(projects: DataFrame, access: str = "all") -> DataFrame:
    if access not in ("all", "public", "private"):
        raise ValueError(f"no access {access}")
    return projects if access == "all" else projects.where(F.col("public") == F.lit(access == "public"))


def by_age(projects: DataFrame, action: str, when: str, hours: float, now: float) -> DataFrame:
    """Projects created or last used before or after so many hours ago."""
    if action not in ("created", "last_used") or when not in ("before", "after"):
        raise ValueError("created or last_used, before or after")
    at = F.lit(now - 3600 * hours)
    return projects.where(F.col(action) < at if when == "before" else F.col(action) >= at)
