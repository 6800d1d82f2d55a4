"""Projections and scalar derivations over wide feature tables.

NaN never travels: values are turned into NULL where they enter (``to_number``).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS_A_MONTH = 30.44
PHI_TAGS = (
    "PatientName PatientBirthDate PatientBirthTime PatientSex PatientAge PatientSize PatientWeight PatientAddress PatientTelephoneNumbers PatientMotherBirthName "
    "OtherPatientIDs OtherPatientNames EthnicGroup Occupation AdditionalPatientHistory PatientComments MilitaryRank BranchOfService PatientReligiousPreference "
    "ResponsiblePerson ReferringPhysicianName ReferringPhysicianAddress ReferringPhysicianTelephoneNumbers PerformingPhysicianName OperatorsName PhysiciansOfRecord "
    "NameOfPhysiciansReadingStudy RequestingPhysician InstitutionName InstitutionAddress InstitutionalDepartmentName StationName DeviceSerialNumber AccessionNumber "
    "StudyID IssuerOfPatientID"
).split()


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns that aren't excluded; reads the schema only."""
    out = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in out]


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def to_number(c: Column | str) -> Column:
    """The value as a double; what isn't a number, and NaN, is NULL."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def blank_to_null(c: Column | str) -> Column:
    x = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(x != "", x)


def months(df: DataFrame, time: str, limit: float = 100.0) -> Column:
    """``time`` in months.  It is taken for days, for the whole table, when its median is
    above ``limit``; the median is a scalar subquery of the same plan."""
    values = df.select(to_number(time).alias("t")).where("t is not null")
    days = values.agg((F.median("t") > limit).alias("d")).select("d").scalar()
    return F.when(days, to_number(time) / DAYS_A_MONTH).otherwise(to_number(time))


def above_median(df: DataFrame, c: str) -> Column:
    return (F.col(c) >= df.agg(F.median(c)).scalar()).cast("int")


def impute_median(df: DataFrame, columns: Iterable[str], statistics: DataFrame | None = None) -> DataFrame:
    """NULLs of ``columns`` replaced by the exact medians of ``statistics`` (by default of
    ``df`` itself): one aggregate of one row, joined back."""
    columns = list(columns)
    if not columns:
        return df
    med = (statistics if statistics is not None else df).agg(*[F.median(c).alias(f"__median_{c}") for c in columns])
    return df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(F.col(c), F.col(f"__median_{c}")) for c in columns}).drop(*[f"__median_{c}" for c in columns])


def columns_with_gaps(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The columns that have NULLs, by one pass."""
    columns = list(columns)
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first() if columns else {}
    return [c for c in columns if gaps[c]]


def medians(df: DataFrame, columns: Iterable[str]) -> dict[str, float]:
    """Exact medians, taken now: ``fill`` with them is ``impute_median`` for tables that are
    read many times, where that one would take the medians at each."""
    columns = list(columns)
    row = df.agg(*[F.median(c).alias(c) for c in columns]).first() if columns else {}
    return {c: row[c] for c in columns if row[c] is not None}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """NULLs, not NaN, replaced by the column's value."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}) if values else df


def column_statistics(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(feature, missing, variance) in one pass, long form."""
    columns = list(columns)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.count_if(F.col("v").isNull()).alias("missing"), F.var_samp("v").alias("variance"))


def usable_columns(df: DataFrame, columns: Iterable[str], least: float = 0.0, complete: bool = True) -> list[str]:
    """The columns whose variance is above ``least`` and, with ``complete``, without NULLs."""
    columns = list(columns)
    rows = column_statistics(df, columns).collect() if columns else []  # one row a column
    good = {r["feature"] for r in rows if (r["variance"] or 0) > least and not (complete and r["missing"])}
    return [c for c in columns if c in good]


def timepoint_label(relative_day: Column, fraction: Column, study_date: Column, study_id: Column) -> Column:
    """``day+28``, else ``fx5``, else the ISO date, else the study's id."""
    return F.coalesce(
        F.when(relative_day.isNotNull(), F.format_string("day%+d", relative_day)),
        F.when(fraction.isNotNull(), F.format_string("fx%d", fraction)),
        F.date_format(study_date, "yyyy-MM-dd"),
        study_id,
    )


def pseudonym(patient_id: Column, salt: str) -> Column:
    """``ANON-`` and 12 hexadecimal digits of the salted SHA-1; blank ids stay blank."""
    x = patient_id.cast("string")
    return F.when(x == "", x).otherwise(F.concat(F.lit("ANON-"), F.substring(F.sha1(F.concat(F.lit(salt), x)), 1, 12)))


def anonymize(df: DataFrame, salt: str, patient_col: str = "PatientID", uid_cols: Iterable[str] = ("SOPInstanceUID", "SeriesInstanceUID", "StudyInstanceUID")) -> DataFrame:
    """Pseudonymous ids, blank personal tags, and uids replaced by salted hashes, which
    keeps the grouping of instances into series and studies."""
    if not salt:
        raise ValueError("a salt is needed")
    change = {t: F.lit("") for t in PHI_TAGS if t in df.columns}
    if patient_col in df.columns:
        change[patient_col] = pseudonym(F.col(patient_col), salt)
    for u in uid_cols:
        if u in df.columns:
            change[u] = F.concat(F.lit("2.25."), F.conv(F.substring(F.sha1(F.concat(F.lit(salt), F.col(u))), 1, 15), 16, 10))
    return df.withColumns(change)


def malignancy_label(diagnosis: Column) -> Column:
    return F.lower(F.trim(diagnosis)).rlike("malig|primary lung").cast("int")


def packed_xy(text: Column) -> Column:
    """(x, y) from ``"x, y"`` or from six digits ``xxxyyy``; NULL otherwise."""
    t = F.trim(text)
    pair, six = r"^(\d+)\s*,\s*(\d+)$", r"^(\d{3})(\d{3})$"
    pattern = F.when(t.rlike(pair), F.lit(pair)).when(t.rlike(six), F.lit(six))
    x, y = F.regexp_extract(t, pair, 1), F.regexp_extract(t, pair, 2)
    a, b = F.regexp_extract(t, six, 1), F.regexp_extract(t, six, 2)
    return F.when(pattern == pair, F.struct(x.try_cast("int").alias("x"), y.try_cast("int").alias("y"))).when(
        pattern == six, F.struct(a.try_cast("int").alias("x"), b.try_cast("int").alias("y"))
    )


FEATURE_NAME = r"^(original|wavelet(-[LH]{3})?|log-sigma-[0-9.-]+-mm(-3D)?|square|squareroot|logarithm|exponential|gradient|lbp-[23]D.*)_(shape|shape2D|firstorder|glcm|glrlm|glszm|gldm|ngtdm)_[A-Za-z0-9]+$"


def standard_name(name: Column) -> Column:
    return name.rlike(FEATURE_NAME)


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def parse_date(text: Column) -> Column:
    """``YYYYMMDD`` or ISO; anything else is NULL."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyy-MM-dd")) if hasattr(F, "try_to_date") else F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def glob_match(c: Column, pattern: str) -> Column:
    """Shell-style pattern over the whole value, matched in the JVM."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"\\[zZ]$", "$", body).replace("(?s:", "(?s)(?:")
    return c.rlike("^" + body)


def search(df: DataFrame, columns: Iterable[str], words: str) -> DataFrame:
    """Rows whose joined columns contain the words, whatever the case."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(words.lower()))


def suv_factor(weight_kg: Column, units: Column, series_s: Column, injection_s: Column, half_life_s: Column, dose_bq: Column, vendor: Column) -> Column:
    """(factor, estimated): body-weight SUV of one stored unit.

    GML is SUV already; CNTS uses the vendor's factor where there is one and is treated as
    BQML otherwise; BQML divides the weight in grams by the decayed dose.  A day is added
    where the scan is before the injection.  Missing weight, dose, times or half-life are
    75 kg, 420 MBq, 6300 s and 6588 s, and make the factor estimated; unknown units give 1.
    """
    gap = series_s - injection_s
    gap = F.when(gap < 0, gap + 86400).otherwise(gap)
    missing = weight_kg.isNull() | dose_bq.isNull() | gap.isNull() | half_life_s.isNull()
    dose = F.coalesce(dose_bq, F.lit(420e6)) * F.exp(-F.log(F.lit(2.0)) * F.coalesce(gap, F.lit(6300.0)) / F.coalesce(half_life_s, F.lit(6588.0)))
    factor = F.coalesce(weight_kg, F.lit(75.0)) * 1000 / dose
    u = F.upper(F.trim(units))
    pick = F.when(u == "GML", F.struct(F.lit(1.0).alias("factor"), F.lit(False).alias("estimated")))
    pick = pick.when((u == "CNTS") & vendor.isNotNull(), F.struct(vendor.cast("double").alias("factor"), F.lit(False).alias("estimated")))
    pick = pick.when(u.isin("BQML", "CNTS"), F.struct(factor.alias("factor"), missing.alias("estimated")))
    return pick.otherwise(F.struct(F.lit(1.0).alias("factor"), F.lit(True).alias("estimated")))
