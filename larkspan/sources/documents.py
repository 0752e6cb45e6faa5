"""Manifests, JSON lines with checks, pitch and label files, tier files, versioned documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import known

ITEM = "struct<path:string,singer:string,labels:map<string,string>,meta:map<string,string>>"
MANIFEST = f"dataset string, root string, items array<{ITEM}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """dataset, root, path, singer, labels, meta, full_path: one row per item."""
    docs = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return docs.select("dataset", "root", F.inline("items")).withColumn("full_path", F.concat_ws("/", "root", "path"))


def write_manifest(items: DataFrame, path: str) -> None:
    """One JSON document per dataset and root; items in the order of their path."""
    row = F.to_json(F.struct("path", "singer", "labels", "meta"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("path", row.alias("j")))), lambda x: F.from_json(x["j"], ITEM))
    items.groupBy("dataset", "root").agg(ordered.alias("items")).write.mode("overwrite").json(path)


def path_parts(files: DataFrame, root: str, names: list[str], path: str = "path") -> DataFrame:
    """Columns from the parts of a path below the root; `skipped` says why a file does not fit."""
    rest = F.regexp_replace(F.col(path), "^.*" + re.escape(root.rstrip("/")) + "/", "")
    parts = F.split(rest, "/")
    ok = F.size(parts) == len(names)
    return files.withColumns({n: F.when(ok, F.get(parts, F.lit(i))) for i, n in enumerate(names)} | {"skipped": F.when(~ok, F.concat(F.lit("depth "), F.size(parts)))})


def stem_join(audio: DataFrame, other: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) audio files by the stem of their name; the other's columns get the prefix `label_`."""
    stem = F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)
    a, b = audio.withColumn("stem", stem), other.withColumn("stem", stem)
    b = b.select("stem", *[F.col(x).alias(f"label_{x}") for x in other.columns])
    return a.join(b, "stem"), a.join(b.select("stem"), "stem", "left_anti")


CONDITIONS = ["clean", "karaoke", "phone", "separated", "trimmed", "multi_singer"]
ROLES = ["target", "take"]
REAL = "id string, audio string, role string, target string, singer string, session string, condition string, lyrics string"


def read_realset(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with `problem`: the first check that a line fails (NULL if it is fine)."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    rows = raw.select("value", F.from_json("value", f"{REAL}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("value", "r.*")
    ids = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("_n"), F.max_by("role", "role").alias("_role"))
    rows = rows.join(ids.select("id", "_n"), "id", "left").join(ids.select(F.col("id").alias("target"), F.col("_role").alias("_trole")), "target", "left")
    missing = [F.when(F.col(x).isNull(), f"missing {x}") for x in ("id", "audio", "role", "condition")]
    checks = [F.when(F.col("_bad").isNotNull(), "not JSON"), *missing, F.when(~F.col("role").isin(*ROLES), "unknown role"), F.when(~F.col("condition").isin(*CONDITIONS), "unknown condition"), F.when(F.col("_n") > 1, "duplicate id"), F.when((F.col("role") == "take") & F.col("_trole").isNull(), "unknown target")]
    return rows.withColumn("problem", F.coalesce(*checks)).drop("_bad", "_n", "_trole", "value")


def read_pitch_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, time, hz from `time,hz` lines; comments (#) and bad rows are dropped, 0 Hz is NULL (unvoiced)."""
    rows = spark.read.text(path).select("_metadata.file_path", F.split(F.trim("value"), r"\s*[,;\t]\s*|\s+").alias("p"), "value").where(~F.col("value").startswith("#"))
    time = known(F.expr("try_cast(get(p, 0) as double)"))
    value = known(F.expr("try_cast(get(p, 1) as double)"))
    return rows.select(F.col("file_path").alias("path"), time.alias("time"), F.when(value > 0, value).alias("hz"), value.alias("_v")).where("time is not null and _v is not null").drop("_v")


def read_semitones(spark: SparkSession, path: str, step: float = 0.02) -> DataFrame:
    """path, time, hz from one semitone number per line and step; 0 is unvoiced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["path"], pdf["content"], strict=True):
                v = pd.to_numeric(pd.Series(bytes(text).decode("utf-8", "replace").split()), errors="coerce").fillna(0)
                yield pd.DataFrame({"path": name, "time": v.index * step, "hz": (440.0 * 2 ** ((v - 69) / 12)).where(v > 0)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, time double, hz double")


def parse_tiers(text: str) -> list[tuple[str, float, float, str]]:
    """(tier, start, end, label) intervals of a tier file in its long or short form: the sequence of its quoted strings and numbers."""
    tokens = re.findall(r'"((?:[^"]|"")*)"|(?<![\w"])(-?\d+(?:\.\d+)?)(?![\w"])', re.sub(r"\[\d+\]", "", text))
    flat = [("n", float(n)) if n else ("s", s.replace('""', '"')) for s, n in tokens]
    out, i = [], 0
    while i < len(flat):
        if flat[i] == ("s", "IntervalTier") and i + 4 < len(flat):
            name, count = str(flat[i + 1][1]), int(float(flat[i + 4][1]))
            i += 5
            for _ in range(count):
                if i + 2 >= len(flat):
                    break
                out.append((name, float(flat[i][1]), float(flat[i + 1][1]), str(flat[i + 2][1])))
                i += 3
        else:
            i += 1
    return out


def read_tiers(spark: SparkSession, path: str) -> DataFrame:
    """path, tier, start, end, label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(raw)
                text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
                rows = [(name, *x) for x in parse_tiers(text)]
                yield pd.DataFrame(rows, columns=["path", "tier", "start", "end", "label"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, tier string, start double, end double, label string")


def key_counts(docs: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """path, n: how many documents have a leaf at each dotted path (lists by their first element), at any depth or down to `depth` levels."""
    rows = docs.where(F.col(column).isNotNull()).select(F.lit("").alias("path"), F.col(column).cast("string").alias("j"))
    found, level = rows.select("path").limit(0), 0
    while level < depth if depth is not None else not rows.isEmpty():
        level += 1
        kind = F.substring(F.ltrim("j"), 1, 1)
        keys = F.when(kind == "{", F.json_object_keys("j")).when((kind == "[") & (F.json_array_length("j") > 0), F.array(F.lit("0")))
        leaf = rows.where(keys.isNull() & (F.col("path") != "")).select("path")
        found = found.unionByName(leaf)
        open_ = rows.where(keys.isNotNull()).select("path", "j", F.explode(keys).alias("k"))
        child = F.when(F.substring(F.ltrim("j"), 1, 1) == "[", F.expr("get_json_object(j, '$[0]')")).otherwise(F.expr("get_json_object(j, concat('$[\\'', k, '\\']'))"))
        rows = open_.select(F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "k").alias("path"), F.coalesce(child, F.lit("null")).alias("j"))
    return found.unionByName(rows.select("path")).groupBy("path").agg(F.count("*").alias("n"))


VERSIONS = {"representation": 2, "explanation": 1, "demo": 2}


def document(kind: str, body: Column) -> Column:
    """JSON text of a versioned document."""
    return F.to_json(F.struct(F.lit(kind).alias("schema"), F.lit(VERSIONS[kind]).alias("version"), body.alias("body")))


def checked(docs: DataFrame, column: str, kind: str, schema: str) -> DataFrame:
    """docs with `body` and `problem`: another schema, a version that is newer than known or below 1; unknown fields are ignored."""
    head = F.from_json(column, f"schema string, version int, body {schema}")
    d = docs.withColumn("_h", head)
    v = F.col("_h.version")
    problem = F.when(F.col("_h.schema").isNull() | (F.col("_h.schema") != kind), "schema").when(v.isNull() | (v < 1), "version").when(v > VERSIONS[kind], "newer version")
    return d.withColumn("problem", problem).withColumn("body", F.when(F.col("problem").isNull(), F.col("_h.body"))).drop("_h")
