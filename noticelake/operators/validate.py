"""Checks of derived analyses: reply contract, evidence against the source text, cross-field rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake import dims, schemas
from noticelake.functions.text import squash

DATE_FIELDS = ["applicationStart", "applicationEnd", "deadline", "eventDate"]
# Fixed pattern: a day, with a time when one is stated.
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2})?$"


def _kind(v: Column, path: str) -> Column:
    """Type name at a path: STRING, VOID for JSON null, SQL null when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path) == "STRING", F.lit(False))


def _is_text_or_null(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path).isin("STRING", "VOID"), F.lit(False))


def _is_text_list(v: Column, path: str) -> Column:
    parts = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.forall(parts, lambda x: _is_text(x, "$")), F.lit(False))


def check_contract(replies: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Adds ``error_class`` (incomplete, not_json, schema or null) and the parsed ``analysis``.

    ``replies``: reply (text) and finished. The raw text stays next to the error class. A type other than
    the declared one is a mismatch even where a cast would succeed.
    """
    parsed = replies.withColumn("_v", F.try_parse_json("reply"))
    v = F.col("_v")
    doubts = F.try_variant_get(v, "$.uncertain", "array<variant>")
    ok = F.try_variant_get(v, "$.category", "string").isin(categories or dims.CATEGORIES) & _is_text(v, "$.category")
    for field in DATE_FIELDS:
        ok = ok & _is_text_or_null(v, f"$.{field}") & _is_text_or_null(v, f"$.evidence.{field}")
    for path in ("$.target", "$.easyExplanation", "$.en.title", "$.en.easyExplanation", "$.en.target"):
        ok = ok & _is_text(v, path)
    ok = ok & _is_text_list(v, "$.summary") & _is_text_list(v, "$.en.summary") & _is_text_or_null(v, "$.en.eventInfo")
    ok = ok & F.coalesce(F.forall(doubts, lambda d: _is_text(d, "$.field") & _is_text(d, "$.reason")), F.lit(False))
    error = (
        F.when(~F.col("finished"), "incomplete").when(v.isNull(), "not_json").when(~F.coalesce(ok, F.lit(False)), "schema")
    )
    out = parsed.withColumn("error_class", error).drop("_v")
    return out.withColumn("analysis", F.when(F.col("error_class").isNull(), F.from_json("reply", schemas.ANALYSIS_JSON)))


def evidence_warnings(analysis: Column, body: Column) -> Column:
    """Each stated date is well formed and backed by a quote that occurs in the body (white space aside)."""

    def checks(plain: Column) -> Column:
        found = []
        for field in DATE_FIELDS:
            value, quote = analysis[field], analysis["evidence"][field]
            malformed = F.concat(F.lit(f'{field}="'), value, F.lit('" is not YYYY-MM-DD[THH:mm]'))
            unquoted = value.isNotNull() & (F.coalesce(quote, F.lit("")) == "")
            missing = F.concat(F.lit(f'{field} evidence "'), quote, F.lit('" not found verbatim in notice'))
            found += [
                F.when(value.isNotNull() & ~value.rlike(DATE_PATTERN), malformed),
                F.when(unquoted, F.lit(f"{field} has a date but no evidence quote"))
                .when(value.isNotNull() & ~F.contains(plain, squash(quote)), missing),
            ]
        return F.array_compact(F.array(*found))

    # bound as a lambda variable, so a long body is squashed once and not once per field
    return F.get(F.transform(F.array(squash(body)), checks), F.lit(0))


def crossfield_warnings(analysis: Column) -> Column:
    """Contradictions between fields of one analysis."""
    start, end, event, due = (analysis[c] for c in ("applicationStart", "applicationEnd", "eventDate", "deadline"))
    n, n_en = F.size(analysis["summary"]), F.size(analysis["en"]["summary"])
    return F.array_compact(F.array(
        F.when((start != "") & (end != "") & (start > end), F.lit("applicationStart is after applicationEnd")),
        F.when(
            (event != "") & (due != "") & (F.substring(event, 1, 10) < F.substring(due, 1, 10)),
            F.concat(F.lit("eventDate "), event, F.lit(" is before the deadline "), due, F.lit("; check which is which")),
        ),
        F.when(~n.between(3, 6), F.format_string("summary has %d bullets (expected 3-6)", n)),
        F.when(n_en != n, F.format_string("en.summary has %d bullets but summary has %d", n_en, n)),
        F.when(event.isNull() & analysis["en"]["eventInfo"].isNotNull(), F.lit("en.eventInfo is set but eventDate is null")),
    ))


def validation_warnings(analysis: Column, body: Column) -> Column:
    return F.concat(evidence_warnings(analysis, body), crossfield_warnings(analysis))


def decode_json_columns(df: DataFrame, column_types: dict[str, str]) -> DataFrame:
    """Every ``*_json`` text column parsed with its declared type and renamed without the suffix."""
    out = []
    for c in df.columns:
        if c.endswith("_json") and c in column_types:
            out.append(F.from_json(c, column_types[c]).alias(c.removesuffix("_json")))
        else:
            out.append(F.col(c))
    return df.select(*out)


STORED_JSON = {
    "summary_json": "array<string>",
    "evidence_json": schemas.EVIDENCE,
    "uncertain_json": "array<struct<field:string,reason:string>>",
    "warnings_json": "array<string>",
    "en_json": schemas.EN,
}


def decode_analysis(stored: DataFrame) -> DataFrame:
    """Stored analyses with nested columns; what older versions lack reads as null."""
    return decode_json_columns(stored, STORED_JSON)
