"""Profiles from untrusted JSON: validated, cleaned, invalid ones dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text

from noticelake import dims, schemas
from noticelake.operators.skew import with_global_index


def validate_profiles(raw: DataFrame, interests: list[str] | None = None, former: dict[str, str] | None = None) -> DataFrame:
    """``raw``: pos (0-based place in the file), id and profile (schemas.PROFILE_FILE)."""
    known = list(dims.INTEREST_LABELS) if interests is None else interests
    renamed = dims.former_colleges() if former is None else former
    year = F.expr("try_cast(profile.year as double)")
    entrance = F.expr("try_cast(profile.entranceYear as double)")
    major = text.strip(F.col("profile.major"))
    valid = (
        (major != "")
        & F.col("profile.college").isNotNull()
        & year.isin(1.0, 2.0, 3.0, 4.0)
        & (entrance == F.floor(entrance))
        & entrance.between(2000, 2100)
    )
    college = F.col("profile.college")
    if renamed:
        names = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
        college = F.coalesce(F.try_element_at(names, college), college)
    chosen = F.array_distinct(F.filter("profile.interests", lambda i: i.isin(known)))
    place = F.concat(F.lit("profile-"), (F.col("pos") + 1).cast("string"))
    return raw.filter(valid).select(
        F.coalesce("id", place).alias("profile_id"), college.alias("college"), major.alias("major"), year.cast("int").alias("year"),
        entrance.cast("int").alias("entrance_year"), F.coalesce(chosen, F.array().cast("array<string>")).alias("interests"),
    )


def load_profiles(spark: SparkSession, path: str, **rules) -> DataFrame:
    """A JSON array or JSON lines of {id, profile}; rows keep the order of the files.

    Lines are read in parallel. An array that spans lines is one document per file and is read as such.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    head = first[0]["value"].strip() if first else ""
    array = head.startswith("[") and not head.endswith("]")
    raw = spark.read.schema(schemas.PROFILE_FILE).option("multiLine", array).json(path)
    placed = raw.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
    numbered = with_global_index(placed, [F.col("_file").asc(), F.col("_row").asc()], "pos")
    return validate_profiles(numbered, **rules)
