"""Readers of the file kinds that cohort studies come in."""

from __future__ import annotations

import json
import gzip
import re
import zlib
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.kernels.volumes import VOLUME, pack
from spindrift.operators.columns import to_number
from spindrift.shipping import ship


def read_table(spark: SparkSession, path: str, *, strings: bool = False) -> DataFrame:
    """CSV with a header, types inferred or all strings, or Parquet by its name."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", not strings).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the distinct trimmed lines of a text file that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def read_feature_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature, value) of files of ``name=value`` lines; values end at ``[``, lines of
    axes and eigenvectors and values that aren't numbers are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("value").contains("="))
    name, value = F.trim(F.substring_index("value", "=", 1)), F.expr("substring(value, instr(value, '=') + 1)")
    out = lines.select("path", name.alias("feature"), to_number(F.trim(F.substring_index(value, "[", 1))).alias("value"))
    return out.where("value is not null and not feature rlike 'PrincipalAxes|Eigenvectors'")


_NRRD_TYPES = {"signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8", "longlong": "i8", "int64": "i8"}


def parse_nrrd(raw: bytes) -> tuple[dict, dict]:
    """(volume, header) of an attached NRRD file, raw or gzip."""
    if not raw.startswith(b"NRRD"):
        raise ValueError("not an NRRD file")
    cut = re.search(rb"\r?\n\r?\n", raw)
    if cut is None:
        raise ValueError("the header has no end")
    head = {}
    for line in raw[: cut.start()].decode("utf-8", "replace").splitlines()[1:]:
        m = re.match(r"([^:#]+):=?\s*(.*)", line)
        if m:
            head[m[1].strip().lower()] = m[2].strip()
    body = raw[cut.end() :]
    if head.get("encoding", "raw").lower() in ("gzip", "gz"):
        body = zlib.decompressobj(31).decompress(body)
    kind = np.dtype(_NRRD_TYPES[head["type"].lower()]).newbyteorder(">" if head.get("endian") == "big" else "<")
    sizes = [int(v) for v in head["sizes"].split()]
    a = np.frombuffer(body, kind, int(np.prod(sizes))).reshape(sizes[::-1]).astype(kind.newbyteorder("="))
    spacing = [1.0] * 3
    vectors = re.findall(r"\(([^)]*)\)", head.get("space directions", ""))
    if len(vectors) >= 3:
        spacing = [float(np.linalg.norm([float(x) for x in v.split(",")])) for v in vectors[-3:]]
    elif "spacings" in head:
        spacing = [float(x) for x in head["spacings"].split()[-3:]]
    origin = re.findall(r"\(([^)]*)\)", head.get("space origin", ""))
    return pack(a, spacing, [float(x) for x in origin[0].split(",")] if origin else (0.0,) * 3), head


def write_nrrd(volume: dict) -> bytes:
    """An attached gzip NRRD file of a volume."""
    kind = {np.dtype(v): k for k, v in reversed(_NRRD_TYPES.items())}[np.dtype(volume["dtype"])]
    sx, sy, sz = volume["spacing"]
    head = [
        "NRRD0004",
        f"type: {kind}",
        "dimension: 3",
        "space: left-posterior-superior",
        f"sizes: {' '.join(str(n) for n in list(volume['shape'])[::-1])}",
        f"space directions: ({sx},0,0) (0,{sy},0) (0,0,{sz})",
        "kinds: domain domain domain",
        "endian: little",
        "encoding: gzip",
        f"space origin: ({','.join(str(v) for v in volume['origin'])})",
    ]
    return ("\n".join(head) + "\n\n").encode() + gzip.compress(volume["data"], mtime=0)


def segments(head: dict) -> list[dict]:
    """Names, labels and layers of the segments that a header lists."""
    out = []
    for k in range(10_000):
        name = head.get(f"segment{k}_name")
        if name is None:
            return out
        out.append({"index": k, "name": name, "label": int(head.get(f"segment{k}_labelvalue", 1)), "layer": int(head.get(f"segment{k}_layer", 0))})
    return out


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, volume, status, error) of the NRRD files below a folder; a bad file is a row
    with its error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nrrd").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            out = []
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    out.append((p, parse_nrrd(raw)[0], "ok", None))
                except Exception as e:  # a bad file must not fail the job
                    out.append((p, None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "volume", "status", "error"])

    return files.mapInPandas(run, f"path string, volume {VOLUME}, status string, error string")


SCORES = "subtlety internalStructure calcification sphericity margin lobulation spiculation texture malignancy".split()
_NODULE = "session int, nodule_id string, scores struct<" + ",".join(f"{s}:int" for s in SCORES) + ">, rois array<struct<sop_uid:string,z:double,xs:array<double>,ys:array<double>>>"


def parse_readings(text: str) -> list[dict]:
    """Nodules of all reading sessions, whatever the namespace; excluded regions are left
    out, missing scores are 0."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]

    def child(e, name):
        return next((c for c in e if tag(c) == name), None)

    def value(e, name):
        c = child(e, name) if e is not None else None
        return (c.text or "").strip() if c is not None else ""

    out = []
    sessions = [e for e in ET.fromstring(text).iter() if tag(e) == "readingSession"]
    for k, s in enumerate(sessions, 1):
        for n in (c for c in s if tag(c) == "unblindedReadNodule"):
            marks = child(n, "characteristics")
            rois = []
            for r in (c for c in n if tag(c) == "roi"):
                if value(r, "inclusion").upper() == "FALSE":
                    continue
                edge = [c for c in r if tag(c) == "edgeMap"]
                rois.append({"sop_uid": value(r, "imageSOP_UID"), "z": float(value(r, "imageZposition") or "nan"), "xs": [float(value(p, "xCoord")) for p in edge], "ys": [float(value(p, "yCoord")) for p in edge]})
            out.append({"session": k, "nodule_id": value(n, "noduleID"), "scores": {c: int(value(marks, c) or 0) for c in SCORES}, "rois": rois})
    return out


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """(path, session, nodule_id, scores, rois) of the annotation files below a folder."""
    ship(spark)
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([{"path": p, **n} for p, t in zip(batch["path"], batch["text"]) for n in parse_readings(t)], columns=["path", "session", "nodule_id", "scores", "rois"])

    return files.mapInPandas(run, f"path string, {_NODULE}")


def flatten_dicom_json(c, keywords: dict[str, str]):
    """``{tag: {vr, Value}}`` as a map of keyword to first value."""
    parsed = F.from_json(c, "map<string,struct<vr:string,Value:array<string>>>")
    named = F.map_filter(F.transform_values(parsed, lambda k, v: F.get(v["Value"], F.lit(0))), lambda k, v: k.isin(list(keywords)))
    names = F.create_map(*[F.lit(x) for kv in keywords.items() for x in kv])
    return F.transform_keys(named, lambda k, v: F.element_at(names, k))


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Columns of a CSV or Parquet file, from its first line or its footer alone."""
    if path.lower().endswith((".parquet", ".pq")):
        return spark.read.parquet(path).columns
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_pairs(spark: SparkSession, path: str) -> list[dict]:
    """A list of {name, minuend, subtrahend}, from JSON or YAML, for ``longitudinal``."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, list):
        raise ValueError(f"{path} isn't a list of pairs")
    return [{k: d[k] for k in ("name", "minuend", "subtrahend")} for d in data]
