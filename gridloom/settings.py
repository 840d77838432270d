"""What a store is made of: arrays, plates with their wells, images and acquisitions, and where it lies. Plain Python, validated before any work."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.layout import RESERVED_FILES, ArraySpec, key_problem, memory_estimate, validate

NAME = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class S3Settings:
    endpoint: str
    bucket: str
    region: str | None = None

    def problems(self) -> list[str]:
        bad = [] if self.endpoint.strip() else ["the endpoint is empty"]
        return bad if 3 <= len(self.bucket.strip()) <= 63 else [*bad, "a bucket's name has 3 to 63 characters"]

    def spark_options(self) -> dict[str, str]:
        """Settings of Hadoop's S3 client; credentials come from its own chain of providers."""
        out = {"fs.s3a.endpoint": self.endpoint, "fs.s3a.path.style.access": "true"}
        return out | ({"fs.s3a.endpoint.region": self.region} if self.region else {})


@dataclass(frozen=True)
class Acquisition:
    id: int
    name: str | None = None
    description: str | None = None
    start_time: int | None = None
    end_time: int | None = None


@dataclass(frozen=True)
class FieldOfView:
    path: str
    array: ArraySpec
    acquisition_id: int | None = None


@dataclass(frozen=True)
class Well:
    row_name: str
    column_name: str
    images: tuple[FieldOfView, ...]


@dataclass(frozen=True)
class Plate:
    path: str
    name: str
    row_names: tuple[str, ...]
    column_names: tuple[str, ...]
    wells: tuple[Well, ...]
    acquisitions: tuple[Acquisition, ...] = ()

    def problems(self) -> list[str]:
        bad = [] if self.path else ["a plate needs a path"]
        bad += [] if self.name else ["a plate needs a name"]
        for what, names in (("row", self.row_names), ("column", self.column_names)):
            if not names:
                bad.append(f"{self.path}: no {what}s")
            if any(not NAME.fullmatch(n or "") for n in names):
                bad.append(f"{self.path}: {what} names are letters and digits")
            if len({n.lower() for n in names}) < len(names):
                bad.append(f"{self.path}: {what} names differ by more than case")
        ids = [a.id for a in self.acquisitions]
        if len(set(ids)) < len(ids) or any(i < 0 for i in ids):
            bad.append(f"{self.path}: acquisition ids are unique and not negative")
        if len({(w.row_name, w.column_name) for w in self.wells}) < len(self.wells):
            bad.append(f"{self.path}: a well is given twice")
        for w in self.wells:
            at = f"{self.path}/{w.row_name}/{w.column_name}"
            if w.row_name not in self.row_names or w.column_name not in self.column_names:
                bad.append(f"{at}: not a row and column of the plate")
            paths = [f.path for f in w.images]
            if not paths:
                bad.append(f"{at}: no images")
            if len(set(paths)) < len(paths) or not all(paths):
                bad.append(f"{at}: image paths are unique and not empty")
            for f in w.images:
                if f.array.key:
                    bad.append(f"{at}/{f.path}: an image's array has no key of its own")
                if f.acquisition_id is not None and f.acquisition_id not in ids:
                    bad.append(f"{at}/{f.path}: unknown acquisition {f.acquisition_id}")
        return bad


def normal_key(key: str) -> str:
    """White space and slashes trimmed off, runs of slashes joined."""
    return re.sub("/+", "/", re.sub(r"^[\s/]+|[\s/]+$", "", key))


@dataclass(frozen=True)
class StoreSettings:
    store_path: str
    arrays: tuple[ArraySpec, ...] = ()
    plates: tuple[Plate, ...] = ()
    overwrite: bool = False
    s3: S3Settings | None = None
    #: Keys of arrays that lie in a group of levels whatever their method: those of plates.
    grouped: frozenset[str] = field(default=frozenset(), init=False)

    def __post_init__(self):
        fields = [(f"{normal_key(p.path)}/{w.row_name}/{w.column_name}/{f.path}", f.array) for p in self.plates for w in p.wells for f in w.images]
        own = tuple(replace(a, key=normal_key(a.key)) for a in self.arrays)
        object.__setattr__(self, "arrays", own + tuple(replace(a, key=k) for k, a in fields))
        object.__setattr__(self, "grouped", frozenset(k for k, _ in fields) | frozenset(a.key for a in own if a.method))

    @property
    def root(self) -> str:
        """The store's place as a URI or folder."""
        return f"s3a://{self.s3.bucket}/{self.store_path.strip('/')}" if self.s3 else self.store_path

    def keys(self) -> list[str]:
        return sorted({a.key for a in self.arrays})

    def memory_estimate(self) -> int:
        return memory_estimate(list(self.arrays)) if self.arrays else 0

    def problems(self) -> list[str]:
        """What is wrong; an empty list if nothing."""
        bad = [] if self.store_path.strip() else ["the store needs a path"]
        if self.s3:
            bad += self.s3.problems()
        elif self.store_path.strip() and "://" not in self.store_path and not Path(self.store_path).absolute().parent.is_dir():
            bad.append("the folder above the store is not there")
        if not self.arrays:
            bad.append("a store has an array or more")
        for a in self.arrays:
            bad += [f"{a.key or 'root'}: {x}" for x in validate(a)]
            if a.key and (why := key_problem(a.key)):
                bad.append(f"{a.key}: {why}")
        for p in self.plates:
            bad += p.problems()
        return bad + self.tree_problems()

    def tree_problems(self) -> list[str]:
        """Keys that can't stand beside each other: twice, below a plain array, or where an array's levels are."""
        keys, bad = [a.key for a in self.arrays], []
        bad += [f"{k or 'root'}: the key is given twice" for k in sorted({k for k in keys if keys.count(k) > 1})]
        for k in sorted(set(keys)):
            if any(part in RESERVED_FILES for part in k.split("/")[1:]):
                bad.append(f"{k}: reserved name")
            for above in set(keys) - {k}:
                if above == "" or k.startswith(above + "/"):
                    child = k[len(above) :].lstrip("/").split("/")[0]
                    if above not in self.grouped:
                        bad.append(f"{k}: below the array {above or 'root'}")
                    elif child.isdigit():
                        bad.append(f"{k}: where the levels of {above or 'root'} are")
        return bad

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The plates as the tables that the plate operators take."""
        rows = [(normal_key(p.path), n, i) for p in self.plates for i, n in enumerate(p.row_names)]
        columns = [(normal_key(p.path), n, i) for p in self.plates for i, n in enumerate(p.column_names)]
        wells = [(normal_key(p.path), w.row_name, w.column_name) for p in self.plates for w in p.wells]
        fovs = [(normal_key(p.path), w.row_name, w.column_name, i, f.path, f.acquisition_id) for p in self.plates for w in p.wells for i, f in enumerate(w.images)]
        acquisitions = [(normal_key(p.path), a.id, a.name, a.description, a.start_time, a.end_time) for p in self.plates for a in p.acquisitions]
        return {
            "rows": spark.createDataFrame(rows, "plate string, name string, idx int"),
            "columns": spark.createDataFrame(columns, "plate string, name string, idx int"),
            "wells": spark.createDataFrame(wells, "plate string, row_name string, column_name string"),
            "fovs": spark.createDataFrame(fovs, "plate string, row_name string, column_name string, ord int, path string, acquisition_id long"),
            "acquisitions": spark.createDataFrame(acquisitions, "plate string, id long, name string, description string, start_time long, end_time long"),
        }
