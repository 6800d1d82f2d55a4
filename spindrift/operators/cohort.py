"""Cohort trees: nested schema, flattening to a manifest, reading and writing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators.columns import timepoint_label

_ROI = "struct<id:string,name:string,volume_cm3:double>"
_RT = f"struct<id:string,path:string,references:string,rois:array<{_ROI}>>"
_IMAGE = "struct<id:string,modality:string,files:array<string>,tag:string>"
_STUDY = f"struct<id:string,date:string,relative_day:int,fraction:int,images:array<{_IMAGE}>,structures:array<{_RT}>>"
_COURSE = f"struct<id:string,dose_cgy:double,fractions:int,studies:array<{_STUDY}>>"
_PATIENT = f"struct<id:string,sex:string,age:double,courses:array<{_COURSE}>,studies:array<{_STUDY}>>"
COHORT = f"name string, patients array<{_PATIENT}>"

MANIFEST_COLUMNS = "patient_id course_id study_id timepoint image_series_id image_path image_tag modality rt_id mask_path mask_tag mask_label mask_image_tag".split()


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """A cohort tree, or several, as JSON documents; missing parts are NULL."""
    return spark.read.schema(T._parse_datatype_string(COHORT)).option("multiLine", True).json(path)


def cohort_from(spark: SparkSession, tree: dict) -> DataFrame:
    """A tree that is already in memory, a parsed YAML file for one."""
    text = spark.createDataFrame([(json.dumps(tree, default=str),)], "j string")
    return text.select(F.from_json("j", T._parse_datatype_string(COHORT).simpleString()).alias("c")).select("c.*")


def flatten_cohort(cohort: DataFrame) -> DataFrame:
    """One row for each image and region of interest, in the manifest's columns.

    A study without images gives no row; an image without structures has blank mask columns,
    and structures without regions a blank ``mask_tag``.  A structure set that references an
    image belongs to it alone; one without a reference belongs to all images of its study
    and comes after the matched ones.  All of it is explodes: no shuffle, no join.
    """
    p = cohort.select(F.explode("patients").alias("p"))
    course = lambda cid, s: F.struct(cid.alias("course_id"), s.alias("s"))
    direct = F.transform(F.coalesce("p.studies", F.array().cast(f"array<{_STUDY}>")), lambda s: course(F.lit(None).cast("string"), s))
    inside = F.flatten(
        F.transform(
            F.coalesce("p.courses", F.array().cast(f"array<{_COURSE}>")),
            lambda c: F.transform(F.coalesce(c["studies"], F.array().cast(f"array<{_STUDY}>")), lambda s: course(c["id"], s)),
        )
    )
    s = p.select(F.col("p.id").alias("patient_id"), F.explode(F.concat(inside, direct)).alias("x")).select("patient_id", "x.course_id", "x.s")
    i = s.select("*", F.explode("s.images").alias("im"))
    rts = F.coalesce("s.structures", F.array().cast(f"array<{_RT}>"))
    own = F.filter(rts, lambda r: r["references"] == F.col("im.id"))
    free = F.filter(rts, lambda r: r["references"].isNull() | (r["references"] == ""))
    r = i.select("*", F.explode_outer(F.concat(own, free)).alias("rt"))
    m = r.select("*", F.explode_outer("rt.rois").alias("roi"))
    label = timepoint_label(F.col("s.relative_day"), F.col("s.fraction"), F.coalesce(F.try_to_timestamp(F.col("s.date"), F.lit("yyyyMMdd")), F.try_to_timestamp(F.col("s.date"))), F.col("s.id"))
    out = m.select(
        "patient_id",
        "course_id",
        F.col("s.id").alias("study_id"),
        label.alias("timepoint"),
        F.col("im.id").alias("image_series_id"),
        F.get("im.files", F.lit(0)).alias("image_path"),
        F.col("im.tag").alias("image_tag"),
        F.col("im.modality").alias("modality"),
        F.col("rt.id").alias("rt_id"),
        F.col("rt.path").alias("mask_path"),
        F.col("roi.name").alias("mask_tag"),
        F.col("roi.id").alias("mask_label"),
        F.when(F.col("rt.id").isNotNull(), F.col("im.tag")).alias("mask_image_tag"),
    )
    return out.na.fill("", MANIFEST_COLUMNS)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """CSV in the canonical column order, extra columns after them, blanks for what's missing."""
    extra = [c for c in manifest.columns if c not in MANIFEST_COLUMNS]
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in manifest.columns else F.lit("").alias(c) for c in [*MANIFEST_COLUMNS, *extra]]
    manifest.select(*cols).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, NULL where blank."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) for c in df.columns])


def images_with_masks(files: DataFrame) -> DataFrame:
    """(patient_id, modality, image_path, mask_path) of a listing (path, length).

    One folder a patient with ``*_mask*`` beside the image, or a flat folder in which the
    mask's name is the image's with ``_mask`` (and ``_image``) taken away.  The first path
    in order is taken where there are several; images without a mask are left out.
    """
    name = F.regexp_extract("path", r"([^/]+?)(\.nii\.gz|\.[A-Za-z0-9]+)$", 1)
    stem = F.regexp_replace(name, r"(_mask-label|_mask|-label|_image)$", "")
    is_mask = name.rlike(r"(_mask|-label)")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    base = files.select("path", stem.alias("stem"), is_mask.alias("m"), folder.alias("folder"))
    got = base.groupBy("folder", "stem").agg(F.min(F.when(~F.col("m"), F.col("path"))).alias("image_path"), F.min(F.when(F.col("m"), F.col("path"))).alias("mask_path"))
    nested = got.withColumn("patient_id", F.when(F.col("stem").startswith(F.col("folder")), F.col("folder")).otherwise(F.col("stem")))
    return nested.where("image_path is not null and mask_path is not null").select("patient_id", F.lit("CT").alias("modality"), "image_path", "mask_path")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
