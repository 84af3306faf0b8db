"""Projects of SQL models: dbt manifests and folders of SQL files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.selections import normal
from skeinwork.plans.parsing import parse
from skeinwork.plans.project import Dataset, with_roots
from skeinwork.plans.values import table_refs
from skeinwork.schemas import GraphError

ENTRY = "struct<unique_id:string,resource_type:string,name:string,alias:string,schema:string,database:string,relation_name:string,package_name:string,compiled_code:string,compiled_sql:string,compiled_path:string,original_file_path:string,depends_on:struct<nodes:array<string>>,columns:map<string,struct<name:string,data_type:string>>>"
KEPT = ("model", "seed", "source")


def load(spark: SparkSession, path: str, dialect: str = "") -> list[Dataset]:
    """A ``manifest.json`` or a folder of SQL; anything else raises."""
    p = Path(path)
    if p.is_dir():
        return load_folder(spark, path, dialect)
    if p.name == "manifest.json":
        return load_manifest(spark, path)
    raise GraphError(f"neither a manifest.json nor a folder: {path}")


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """A row per model, seed and source of a manifest, with its identity."""
    text = spark.read.text(str(path), wholetext=True)
    parsed = text.select(F.from_json("value", f"struct<nodes:map<string,{ENTRY}>,sources:map<string,{ENTRY}>>").alias("m"))
    both = F.concat(F.map_entries(F.coalesce("m.nodes", F.create_map().cast(f"map<string,{ENTRY}>"))), F.map_entries(F.coalesce("m.sources", F.create_map().cast(f"map<string,{ENTRY}>"))))
    rows = parsed.select(F.explode(both).alias("e")).select(F.col("e.key").alias("uid"), "e.value.*")
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    dotted = lambda *cs: F.when(F.concat(*[given(F.col(c)) for c in cs]).isNotNull(), F.concat_ws(".", *cs))
    identity = F.coalesce(given(F.col("relation_name")), dotted("database", "schema", "alias"), dotted("schema", "alias"), given(F.col("alias")), dotted("database", "schema", "name"), dotted("schema", "name"), F.col("name"))
    sql = F.coalesce(given(F.col("compiled_code")), given(F.col("compiled_sql")))
    kind = F.coalesce("resource_type", F.when(F.col("uid").startswith("source."), "source"))
    return rows.select("uid", kind.alias("resource_type"), identity.alias("identity"), sql.alias("sql"), "compiled_path", "original_file_path", F.col("depends_on.nodes").alias("needs"), "columns").filter(F.col("resource_type").isin(*KEPT))


def manifest_dependencies(entries: DataFrame) -> DataFrame:
    """(uid, identity, position) of each dependency; an unknown source is named by its last part."""
    needs = entries.select("uid", F.posexplode("needs").alias("position", "need"))
    names = entries.select(F.col("uid").alias("need"), "identity")
    found = needs.join(names, "need", "left")
    return found.select("uid", "need", "position", F.coalesce("identity", F.when(F.col("need").startswith("source."), F.substring_index("need", ".", -1))).alias("identity"))


def _compiled(root: Path, path: str | None, uid: str) -> str:
    if not path:
        raise GraphError(f"{uid} has no compiled SQL")
    full = (root / path).resolve()
    if not full.is_relative_to(root.resolve()):
        raise GraphError(f"{uid}: compiled_path leaves the manifest's folder")
    if not full.is_file():
        raise GraphError(f"{uid}: no file at compiled_path")
    return full.read_text()


def load_manifest(spark: SparkSession, path: str) -> list[Dataset]:
    """Models as local datasets, seeds and sources as roots. Two entries of one identity, unknown dependencies and lost SQL raise."""
    json.loads(Path(path).read_text())  # a broken file raises here, with its place
    entries = manifest_entries(spark, path)
    needs: dict[str, list[str]] = {}
    for r in manifest_dependencies(entries).orderBy("uid", "position").collect():
        if r.identity is None and r.need.partition(".")[0] in KEPT:
            raise GraphError(f"{r.uid} depends on the unknown {r.need}")
        if r.identity is not None:
            needs.setdefault(r.uid, []).append(normal(r.identity))
    out, seen = [], {}
    for r in entries.orderBy("uid").collect():
        name = normal(r.identity)
        if name in seen:
            raise GraphError(f"{r.uid} and {seen[name]} are both {name}")
        seen[name] = r.uid
        local = r.resource_type == "model"
        columns = {(v["name"] or k).lower(): v["data_type"] for k, v in (r["columns"] or {}).items()}
        sql = (r.sql or _compiled(Path(path).parent, r.compiled_path, r.uid)) if local else None
        out.append(Dataset(name, "local" if local else "root", sql, needs.get(r.uid, []), list(columns), {k: v for k, v in columns.items() if v}, r.original_file_path))
    return with_roots(out)


def catalog_types(spark: SparkSession, path: str) -> DataFrame:
    """(uid, column, type) of a dbt catalog."""
    entry = "struct<columns:map<string,struct<name:string,type:string>>>"
    text = spark.read.text(str(path), wholetext=True)
    parsed = text.select(F.from_json("value", f"struct<nodes:map<string,{entry}>,sources:map<string,{entry}>>").alias("c"))
    parts = [parsed.select(F.explode(f"c.{k}").alias("uid", "e")).select("uid", F.explode("e.columns").alias("key", "v")) for k in ("nodes", "sources")]
    return parts[0].unionByName(parts[1]).select("uid", F.lower(F.coalesce("v.name", "key")).alias("column"), F.col("v.type").alias("type"))


def load_folder(spark: SparkSession, path: str, dialect: str = "") -> list[Dataset]:
    """Every ``*.sql`` below a folder; a dataset is named by its dotted relative path. An empty file or a name given twice raises."""
    root = Path(path).resolve()
    out: dict[str, Dataset] = {}
    for f in sorted(root.rglob("*.sql")):
        if not f.resolve().is_relative_to(root):
            raise GraphError(f"{f.name} leaves the folder")
        name = ".".join(f.relative_to(root).with_suffix("").parts).lower()
        sql = f.read_text()
        if not sql.strip():
            raise GraphError(f"{f.name} is empty")
        if name in out:
            raise GraphError(f"{name} is given twice")
        out[name] = Dataset(name, "local", sql, file=str(f.relative_to(root)))
    for d in out.values():
        try:
            refs = table_refs(parse(spark, d.sql, dialect))
        except GraphError:
            refs = []
        d.dependencies = sorted({r for r in refs if r in out and r != d.name})
    return list(out.values())


def overlay(datasets: list[Dataset], types: dict[str, dict[str, str]]) -> list[Dataset]:
    """Add column types (and so columns) to datasets; a dataset that isn't there becomes a root. A blank type raises."""
    by_name = {d.name: d for d in datasets}
    for name, columns in types.items():
        name = normal(name)
        if blank := [c for c, t in columns.items() if not (t or "").strip()]:
            raise GraphError(f"{name}: blank type of {', '.join(sorted(blank))}")
        d = by_name.setdefault(name, Dataset(name, "root"))
        d.types |= {c.lower(): t for c, t in columns.items()}
        d.columns = list(dict.fromkeys([*d.columns, *d.types]))
    return list(by_name.values())
