"""Small state beside the tables: projects, settings, ground truth, results of evaluations."""

from __future__ import annotations

import json
import os
import pathlib
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import params

TABLES = {
    "documents": "doc string, path string, line_count int, expected_chunks int, created_at timestamp",
    "sections": "doc string, section_no int, title string, level int, start_line int, end_line int",
    "chunks": "chunk_id long, doc string, section_no int, start_line int, end_line int, word_count int, text string, is_index boolean",
    "embeddings": "chunk_id long, embedding array<float>, at timestamp",
    "chunk_contexts": "chunk_id long, context string, model string, at timestamp",
    "query_cache": "id long, embedding array<double>, vector_results array<struct<chunk_id:long,score:double>>, created_at double, model string, candidate_count int",
}


def _save(path: pathlib.Path, value: object) -> None:
    """Writes JSON in one step: a reader sees the old file or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, indent=2)
    os.replace(temporary, path)


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """The tables of a project, where they are not there yet; location: the folder of a new database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`" + (f" LOCATION '{location}'" if location else ""))
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def open_table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"`{database}`.`{name}`")


class Meta:
    """Settings by key."""

    def __init__(self, path: str):
        self.path = pathlib.Path(path)

    def all(self) -> dict[str, dict]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def get(self, key: str) -> str | None:
        return self.all().get(key, {}).get("value")

    def set(self, key: str, value: str) -> None:
        _save(self.path, self.all() | {key: {"value": value, "updated_at": time.time()}})


class Projects:
    """A registry of projects: id and folder of documents, as JSON."""

    def __init__(self, path: str, home: str):
        self.path, self.home, self.active = pathlib.Path(path), pathlib.Path(home), None

    def all(self) -> list[dict[str, str]]:
        if not self.path.exists():
            return []
        try:
            value = json.loads(self.path.read_text(encoding="utf-8"))
        except ValueError as error:
            raise ValueError(f"{self.path} is no JSON") from error
        rows = value.get("projects") if isinstance(value, dict) else None
        if not isinstance(rows, list) or not all(isinstance(x, dict) and isinstance(x.get("docs_dir"), str) for x in rows):
            raise ValueError(f"{self.path} holds no list of projects")
        out: dict[str, dict[str, str]] = {}
        for row in rows:
            folder, name = os.path.abspath(os.path.expanduser(row["docs_dir"])), row.get("id")
            name = (name.strip() if isinstance(name, str) else "") or os.path.basename(folder) or "project"  # an id, or the folder's name
            if name.lower() in params.RESERVED_PROJECTS:
                raise ValueError(f"{self.path} holds the reserved id {name}")
            if name in out:
                raise ValueError(f"{self.path} holds the id {name} twice")
            out[name] = {"id": name, "docs_dir": folder}
        return list(out.values())

    def get(self, name: str) -> dict[str, str] | None:
        """A project by id or by folder."""
        rows = self.all()
        by_id = next((x for x in rows if x["id"] == name), None)
        return by_id or next((x for x in rows if os.path.abspath(x["docs_dir"]) == os.path.abspath(os.path.expanduser(name))), None)

    def add(self, docs_dir: str, project: str | None = None) -> dict[str, str]:
        folder = os.path.abspath(os.path.expanduser(docs_dir))
        if not os.path.isdir(folder):
            raise ValueError(f"{folder} is no folder")
        if found := next((x for x in self.all() if x["docs_dir"] == folder), None):
            return found
        base = re.sub(r"[^a-z0-9._-]+", "-", (project or os.path.basename(folder)).lower()).strip("-.") or "project"
        taken, name, n = {x["id"] for x in self.all()} | set(params.RESERVED_PROJECTS), base, 2
        if project and base in taken:
            raise ValueError(f"{base} is taken or reserved")
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        new = {"id": name, "docs_dir": folder}
        _save(self.path, {"projects": [*self.all(), new]})
        return new

    def remove(self, name: str, keep_data: bool = False) -> bool:
        import shutil

        if not (found := self.get(name)):
            return False
        _save(self.path, {"projects": [x for x in self.all() if x["id"] != found["id"]]})
        if not keep_data:
            shutil.rmtree(self.data_dir(found["id"]), ignore_errors=True)
        return True

    def data_dir(self, project: str) -> pathlib.Path:
        return self.home / project

    def activate(self, name: str) -> dict[str, str]:
        if not (found := self.get(name)):
            raise KeyError(name)
        self.data_dir(found["id"]).mkdir(parents=True, exist_ok=True)
        self.active = found
        return found


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(queries, qrels) of a JSON file of judged queries; None if it can't be read. Other fields of the envelope drop out."""
    rows = spark.read.option("multiLine", "true").schema("queries array<struct<id:string,query:string,category:string,subtopics:array<string>,judgments:array<struct<chunk_id:long,doc:string,score:int,confidence:double,subtopics:array<string>,reason:string>>>>, _corrupt_record string")
    try:
        found = rows.json(path)
        if found.where("queries is null").limit(1).count() or found.isEmpty():
            return None
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    q = found.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("qid"), "q.query", "q.category", "q.subtopics", "q.judgments")
    judged = q.select("qid", F.explode("judgments").alias("j")).select("qid", "j.*")
    return q.drop("judgments"), judged


def save_ground_truth(queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """One JSON file of all judged queries, which a person reads; written in one step."""
    lists = qrels.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "doc", "score", "confidence", "subtopics", "reason"))).alias("judgments"))
    rows = queries.join(lists, "qid", "left").orderBy("qid").toLocalIterator()
    out = [{"id": r["qid"], "query": r["query"], "category": r["category"], "subtopics": r["subtopics"] or [], "judgments": [j.asDict() for j in r["judgments"] or []]} for r in rows]
    _save(pathlib.Path(path), {"queries": out})


def save_result(folder: str, name: str, values: DataFrame, **more: object) -> pathlib.Path:
    """{name}.json with the means (metric, k, value) of a run."""
    metrics: dict[str, dict[str, float]] = {}
    for r in values.orderBy("metric", "k").collect():  # a few cutoffs of a few metrics
        metrics.setdefault(r["metric"], {})[str(r["k"])] = r["value"]
    path = pathlib.Path(folder) / f"{name}.json"
    _save(path, {"name": name, "created": time.strftime("%Y-%m-%d %H:%M:%S"), "metrics": metrics} | more)
    return path


def results(folder: str, most: int = 10) -> tuple[list[dict], int]:
    """The newest results of a folder, and the number of files that can't be read."""
    found, bad = [], 0
    for path in sorted(pathlib.Path(folder).glob("*.json"), key=lambda p: p.stat().st_mtime, reverse=True)[:most]:
        try:
            found.append(json.loads(path.read_text(encoding="utf-8")))
        except (OSError, ValueError):
            bad += 1
    return found, bad
