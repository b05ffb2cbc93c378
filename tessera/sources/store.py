"""The tables' home: versions of each table in folders, schema changes as numbered files, small documents, and profile files.

A write makes a new folder and readers open the newest finished one, so a run that dies leaves the last version as it was."""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vocabulary as V


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _fs(spark, path)
    return bool(fs.exists(where))


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no folder."""
    fs, where, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small document, written beside its place and then moved there, so that a reader sees the old or the new one."""
    fs, where, jvm = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=0, sort_keys=True).encode()))
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(beside, where)


def read_json(spark: SparkSession, path: str, default=None):
    """The document at ``path``; ``default`` if there is none or it cannot be read."""
    fs, where, _ = _fs(spark, path)
    if not fs.exists(where):
        return default
    rows = spark.read.text(path, wholetext=True).collect()  # one small document
    try:
        return json.loads(rows[0][0]) if rows else default
    except ValueError:
        return default


class Store:
    """Versioned tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        found = [int(m[1]) for n in names(self.spark, f"{self.root}/{table}") if (m := re.fullmatch(r"v=(\d+)", n))]
        return [v for v in sorted(found) if exists(self.spark, f"{self.root}/{table}/v={v:08d}/_SUCCESS")]

    def read(self, table: str) -> DataFrame:
        """The newest finished version; an unknown table is a KeyError."""
        versions = self._versions(table)
        if not versions:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.root}/{table}/v={versions[-1]:08d}")

    def write(self, table: str, df: DataFrame, keep: int = 2) -> int:
        """A new version, which replaces none; versions before the last ``keep`` go."""
        versions = self._versions(table)
        number = (versions[-1] if versions else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v={number:08d}")
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            fs, where, _ = _fs(self.spark, f"{self.root}/{table}/v={old:08d}")
            fs.delete(where, True)
        return number

    def migrate(self, scripts: dict[int, str]) -> int:
        """Apply the numbered ``scripts`` above the stored version in order; the version reached.

        A script is statements, ``table := select ...`` each, over the stored tables as views; all of a script's tables
        are written before its number is stored, and a number that is stored never runs again."""
        place = f"{self.root}/version.json"
        current = (read_json(self.spark, place, {}) or {}).get("version", 0)
        for number in sorted(n for n in scripts if n > current):
            for table in names(self.spark, self.root):
                if self._versions(table):
                    self.read(table).createOrReplaceTempView(table)
            made = []
            for statement in filter(None, (s.strip() for s in scripts[number].split(";"))):
                table, _, select = statement.partition(":=")
                made.append((table.strip(), self.spark.sql(select)))
            for table, df in made:
                self.write(table, df)
            write_json(self.spark, place, {"version": number})
            current = number
        return current


_shared: dict[str, Store] = {}


def shared(spark: SparkSession, root: str, scripts: dict[int, str] | None = None) -> Store:
    """The process's store at ``root``, migrated when it is first asked for."""
    if root not in _shared:
        _shared[root] = Store(spark, root)
        _shared[root].migrate(scripts or {})
    return _shared[root]


# ---------------------------------------------------------------- profiles


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "profile"


def register_profile(registry: dict, name: str, suffix: str, now: str) -> tuple[str, dict]:
    """(id, registry) with a new profile; an id that is taken gets a number."""
    base = slug(name)
    new = next(x for x in (base, *(f"{base}_{k}" for k in range(2, len(registry) + 3))) if x not in registry)
    return new, {**registry, new: {"name": name, "filename": f"{new}{suffix}", "uploaded_at": now}}


def remove_profile(registry: dict, profile_id: str) -> dict:
    return {k: v for k, v in registry.items() if k != profile_id}


def with_overrides(stored: dict, profile_id: str, overrides: dict[str, str]) -> dict:
    """The families boosted or blocked by profile, with one profile's set; none leave no entry."""
    if wrong := set(overrides.values()) - {"boost", "block"}:
        raise ValueError(f"unknown actions: {sorted(wrong)}")
    rest = {k: v for k, v in stored.items() if k != profile_id}
    return {**rest, profile_id: dict(overrides)} if overrides else rest


def document_text(name: str, data: bytes) -> str | None:
    """The text of a CV file: paragraphs and table cells of a .docx, a .txt as it is, null for what cannot be read here."""
    low = name.lower()
    if low.endswith(".txt"):
        return data.decode("utf-8", "replace")
    if not low.endswith(".docx"):
        return None
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


@F.arrow_udf(T.StringType())
def read_documents(files: pa.Array, contents: pa.Array) -> pa.Array:
    return pa.array([None if d is None else document_text(n or "", d) for n, d in zip(files.to_pylist(), contents.to_pylist())], pa.string())


def cv_texts(spark: SparkSession, path: str) -> DataFrame:
    """(profile_id, text) of the CV files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.regexp_replace(name, r"\.\w+$", "").alias("profile_id"), read_documents(name, "content").alias("text"))


# ---------------------------------------------------------------- settings


def scoring_bundle(stored: dict | None = None) -> dict:
    """Weights and family coefficients: the defaults, replaced by those a weight search has stored. Weights that do not sum
    to 1, and unknown names, are a ValueError."""
    stored = stored or {}
    out = {}
    for part, default in (("weights", V.WEIGHTS), ("family_fit", V.FAMILY_FIT)):
        own = stored.get(part, {})
        if wrong := set(own) - set(default):
            raise ValueError(f"unknown {part}: {sorted(wrong)}")
        out[part] = {**default, **own}
    if abs(sum(out["weights"].values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return out


def put_plan(spark: SparkSession, root: str, plan: dict) -> str:
    """One JSON file per company; the file's name is the company's id."""
    path = f"{root.rstrip('/')}/{plan['company_id']}.json"
    write_json(spark, path, plan)
    return path


def page(template: str, rows: DataFrame, most: int = 50_000, **values: str) -> str:
    """A self-contained page: ``{{rows}}`` in the template is the rows as JSON, ``{{name}}`` a value. A page is for a reader, so
    more than ``most`` rows are a ValueError, not a cut."""
    found = rows.limit(most + 1).toJSON().collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows in a page")
    out = template.replace("{{rows}}", "[" + ",".join(found).replace("</", "<\\/") + "]")
    for name, value in values.items():
        out = out.replace("{{" + name + "}}", value)
    return out
