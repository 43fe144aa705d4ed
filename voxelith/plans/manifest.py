"""Which stages are done, by the hash of what they depend on.

A stage's outcome is valid as long as its key is the recorded one. A changed parameter, a
changed input file or a changed stage above gives another key, so nothing stale is reused
and nothing has to be invalidated by name.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession


class Manifest:
    """Stage outcomes under a folder: Parquet tables or files, and a JSON record of their keys."""

    def __init__(self, folder: str):
        self.folder = folder
        self.path = os.path.join(folder, "manifest.json")
        self.record: dict[str, dict] = {}
        try:
            with open(self.path, encoding="utf-8") as f:
                self.record = json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            pass

    def done(self, stage: str, key: str) -> bool:
        found = self.record.get(stage)
        return bool(found) and found["key"] == key and all(os.path.exists(p) for p in found["paths"])

    def mark(self, stage: str, key: str, paths: list[str], facts: dict | None = None) -> None:
        self.record[stage] = {"key": key, "paths": paths, "facts": facts or {}}
        os.makedirs(self.folder, exist_ok=True)
        temporary = f"{self.path}.part"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(self.record, f, indent=2)
        os.replace(temporary, self.path)

    def facts(self, stage: str) -> dict:
        return self.record.get(stage, {}).get("facts", {})

    def forget(self, stage: str) -> None:
        for path in self.record.pop(stage, {}).get("paths", []):
            if os.path.isdir(path):
                shutil.rmtree(path, ignore_errors=True)
            elif os.path.exists(path):
                os.remove(path)

    def clear(self) -> None:
        for stage in list(self.record):
            self.forget(stage)
        if os.path.exists(self.path):
            os.remove(self.path)

    def table(self, spark: SparkSession, stage: str, key: str, make, facts: dict | None = None) -> DataFrame:
        """The stage's table, made and written only if its key is new."""
        if not self.done(stage, key):
            path = os.path.join(self.folder, f"{stage}-{key}")
            make().write.mode("overwrite").parquet(path)
            old = self.record.get(stage, {}).get("paths", [])
            self.mark(stage, key, [path], facts)
            for gone in old:
                if gone != path:
                    shutil.rmtree(gone, ignore_errors=True)
        return spark.read.parquet(self.record[stage]["paths"][0])
