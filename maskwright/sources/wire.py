"""Schemas of records on the wire, and readers that refuse fields the schema doesn't have."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X

RAW_ELEMENT = "struct<vid:int,role:string,tag:string,type:string,label:string,value:string,hasValue:boolean,placeholder:string,name:string,idAttr:string,autocomplete:string,required:boolean,disabled:boolean,checked:boolean,options:array<string>,bbox:array<double>,valueBox:array<double>>"
RAW_SPAN = "struct<cls:string,start:int,end:int,value:string,valid:boolean,token:string,layer:string>"
RAW_TEXT = f"struct<vid:int,text:string,bbox:array<double>,spans:array<{RAW_SPAN}>>"
RAW_RASTER = "struct<vid:int,kind:string,alt:string,bbox:array<double>,src:string,inner:array<double>>"
SNAPSHOT = f"snapshot_id string, source string, url string, title string, viewport array<int>, dpr double, ms int, elements array<{RAW_ELEMENT}>, texts array<{RAW_TEXT}>, rasters array<{RAW_RASTER}>"
VISION = "snapshot_id string, key string, ok boolean, faces array<array<double>>, codes array<array<double>>, lines array<struct<text:string,bbox:array<double>,chars:array<array<double>>>>, error string"
ELEMENT = "struct<id:int,role:string,label:string,value:string,placeholder:string,field_class:string,required:boolean,disabled:boolean,checked:boolean,options:array<string>,masked:boolean,bbox:array<double>,src:string>"
SCREEN = f"struct<origin:string,path_template:string,title:string,state:struct<class:string,confidence:double,src:string>,viewport:array<int>,image:string,elements:array<{ELEMENT}>,texts:array<struct<id:int,text:string,bbox:array<double>>>>"
ENTITY = "struct<token:string,class:string,group:string,format:string,valid_checksum:boolean,source:string>"
STEP_REQUEST = f"session_id string, vrs_version string, goal string, step int, mode string, screen {SCREEN}, entities array<{ENTITY}>, history array<struct<step:int,summary:string>>"
ACTION_FIELDS = "type string, target int, text string, option string, direction string, amount int, key string, ms int, message string, requires_confirmation boolean"
#: Fields that a request must have, by path; others have defaults.
REQUIRED = ["session_id", "vrs_version", "goal", "step", "mode", "screen", "screen.origin", "screen.path_template", "screen.state", "screen.state.class", "screen.state.confidence", "screen.viewport", "screen.elements"]


def _unknown(value, kind: T.DataType, path: str) -> Iterator[str]:
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        known = {f.name: f.dataType for f in kind.fields}
        for k, v in value.items():
            here = f"{path}.{k}" if path else k
            if k not in known:
                yield here
            else:
                yield from _unknown(v, known[k], here)
    elif isinstance(kind, T.ArrayType) and isinstance(value, list):
        for i, v in enumerate(value):
            yield from _unknown(v, kind.elementType, f"{path}[{i}]")


def _missing(value) -> Iterator[str]:
    for path in REQUIRED:
        at = value
        for k in path.split("."):
            at = at.get(k) if isinstance(at, dict) else None
        if at is None:
            yield path


def unknown_fields(raw: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """raw with `unknown` (paths of fields outside of the schema) and `missing` (required fields that aren't there)."""

    def told(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                value = json.loads(t) if t is not None else None
            except ValueError:
                value = None
            out.append((list(_unknown(value, schema, "")), list(_missing(value)) if isinstance(value, dict) else ["body"]))
        return pd.DataFrame(out, columns=["unknown", "missing"])

    check = F.pandas_udf(told, "unknown array<string>, missing array<string>")
    return raw.withColumn("_told", check(F.col(column))).select("*", "_told.unknown", "_told.missing").drop("_told")


def parsed_requests(raw: DataFrame, column: str = "json") -> DataFrame:
    """Requests parsed by their schema, with `schema_ok`: no unknown field, all required ones, values of the lists."""
    schema = T.StructType.fromDDL(STEP_REQUEST)
    rows = unknown_fields(raw, schema, column).withColumn("r", F.from_json(column, schema))
    listed = F.col("r.mode").isin("pixel", "structure") & F.forall("r.screen.elements", lambda e: e["role"].isin(X.ROLES) & (e["field_class"].isNull() | e["field_class"].isin(list(X.GROUPS))) & (F.size(e["bbox"]) == 4))
    listed = listed & F.forall(F.coalesce("r.entities", F.array().cast(f"array<{ENTITY}>")), lambda e: e["class"].isin(list(X.GROUPS)) & e["group"].isin(sorted(set(X.GROUPS.values()))))
    ok = F.coalesce((F.size("unknown") == 0) & (F.size("missing") == 0) & listed, F.lit(False))
    return rows.withColumn("schema_ok", ok).select(*[c for c in rows.columns if c != "r"], "schema_ok", "r.*")


def read_requests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Requests of JSON files: one in each file, or with `lines` one in each line."""
    return spark.read.schema(STEP_REQUEST).option("multiLine", not lines).json(path)


def read_settings(stored: dict | None, patch: dict | None = None) -> dict:
    """Defaults under stored values under a patch."""
    return {"serverUrl": "http://localhost:8000", "terms": [], "paranoid": False} | (stored or {}) | (patch or {})


def sanitized_only(screens: DataFrame, passed: DataFrame, path: str) -> None:
    """Writes the screens that passed the firewall (id, ok); no others, nor any without a verdict."""
    screens.join(passed.where(F.col("ok")).select("id"), screens.snapshot_id == passed.id, "left_semi").write.mode("errorifexists").parquet(path)


def request_of(goal: Column, screen: Column, entities: Column, history: Column, session_id: Column, step: Column, mode: Column, image: Column) -> Column:
    """A step request: the last items of the history, the image only in pixel mode."""
    kept = F.when(F.size(history) > X.MAX_HISTORY, F.slice(history, -X.MAX_HISTORY, X.MAX_HISTORY)).otherwise(history)
    return F.struct(
        session_id.alias("session_id"), F.lit(X.VERSION).alias("vrs_version"), goal.alias("goal"), step.alias("step"), mode.alias("mode"),
        screen.withField("image", F.when(mode == "pixel", image)).alias("screen"), entities.alias("entities"), kept.alias("history"),
    )
