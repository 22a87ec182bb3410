"""Scalar functions of the workbench, as column expressions (they stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings in titles (fixed values): of whole words, of a last word, of parts of words.
TITLE_WORDS = {"Ph": "pH", "Cas": "CAS", "Ad": "AD"}
TITLE_LAST = {"Id": "ID", "Cid": "CID"}
TITLE_PARTS = {"Qc": "QC", "Url": "URL", "Doi": "DOI", "Dtxsid": "DTXSID", "Dtxrid": "DTXRID", "Dtxcid": "DTXCID", "Casrn": "CASRN", "Qsar": "QSAR", "Smiles": "SMILES", "Pubchem": "PubChem"}
INF = float("inf")


def clean_double(text: Column) -> Column:
    """A number from text; what isn't a finite number is null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def first_part(x: Column) -> Column:
    """What stands before the first pipe, trimmed."""
    return F.trim(F.split_part(x, F.lit("|"), F.lit(1)))


def sanitised_name(name: Column, fallback_id: Column) -> Column:
    """Lower case, runs of other characters made one underscore; param_<id> if nothing is left."""
    bare = F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.concat(F.lit("param_"), fallback_id.cast("string")))


def title(name: Column) -> Column:
    """A column's name as a heading: without exp_details_ and _str, underscores to spaces, words capitalised, known abbreviations in their own spelling."""
    bare = F.replace(F.replace(name, F.lit("exp_details_"), F.lit("")), F.lit("_str"), F.lit(""))
    out = F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))
    for pattern, fixes in ((r"\b{}\b", TITLE_WORDS), (r"(?<=\s){}(?=\s?$)", TITLE_LAST), ("{}", TITLE_PARTS)):
        for said, meant in fixes.items():
            out = F.regexp_replace(out, pattern.format(said), meant)
    return out


def escaped_cell(x: Column, how: str = "formula") -> Column:
    """Cells that a sheet would take for a formula: as a formula that gives the text, or with a leading quote."""
    safe = F.concat(F.lit('="'), x, F.lit('"')) if how == "formula" else F.concat(F.lit("'"), x)
    return F.when(x.rlike("^[=+@-]"), safe).otherwise(x)


def short_number(x: Column) -> Column:
    """Three significant digits: exponential below 0.01 and above 1000, else without trailing zeros."""
    a, spelled = F.abs(x), F.format_string("%.2e", x)
    plain = F.regexp_replace(spelled.cast("double").cast("string"), r"\.0$", "")
    thousand = F.when(x < 0, "-1e+03").otherwise("1e+03")
    return F.when(x == 0, F.lit("0")).when((a < 0.01) | (a > 1000), spelled).when(F.abs(spelled.cast("double")) >= 1000, thousand).otherwise(plain)


def parameter_text(low: Column, high: Column, point: Column, unit: Column, text: Column) -> Column:
    """A parameter's value as text: a range, a bound, a value with its unit, or its own text; the unit Text is none."""
    u = F.when(unit.isNull() | (unit == "Text"), F.lit("")).otherwise(unit)
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lo, hi = short_number(low), short_number(high)
    return (
        F.when(low.isNotNull() & high.isNotNull(), said(lo, " ", u, " < value < ", hi, " ", u))
        .when(low.isNotNull(), said(" > ", lo, " ", u))
        .when(high.isNotNull(), said(" < ", hi, " ", u))
        .when(point.isNotNull(), said(short_number(point), " ", u))
        .otherwise(text)
    )


def safe_divide(a: Column, b: Column) -> Column:
    """Null where b is 0 or either is null."""
    return F.try_divide(a, b)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x)


def json_default(doc: Column, path: str, default: str) -> Column:
    """A field of a JSON text; the default if the text or the field is missing."""
    return F.coalesce(F.get_json_object(doc, path), F.lit(default))


def json_number(doc: Column, path: str) -> Column:
    """A nested field as a number; null if the text is no JSON or the field no number."""
    return F.try_variant_get(F.try_parse_json(doc), path, "double")


def truncated_list(items: Column, limit: int = 100) -> Column:
    joined = F.array_join(items, ", ")
    return F.when(F.length(joined) > limit, F.concat(F.substring(joined, 1, limit), F.lit("..."))).otherwise(joined)


def first_metric(metrics: Column, *names: str) -> Column:
    """The first of several metrics that a map has."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


def class_flag(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*positive), 1).when(low.isin(*negative), 0)


def unique_name(name: Column, index: Column) -> Column:
    """Without other characters than letters and digits; the position keeps names apart."""
    return F.concat(F.regexp_replace(name, "[^a-zA-Z0-9]", ""), F.lit("_"), (index + 1).cast("string"))


def conclusion(inside: Column) -> Column:
    return F.when(inside, "Inside").when(~inside, "Outside")


def distance_reason(inside: Column, value: Column, cutoff: Column) -> Column:
    """Why a mean distance puts a row inside or outside a domain; null without a flag."""
    said = lambda sign: F.format_string(f"Avg. distance (%.2f) {sign} %.2f", value, cutoff)
    return F.when(inside, said("<")).when(~inside, said(">"))


def fragment_reason(inside: Column, all_in_model: Column) -> Column:
    """The same for fragments; a fragment that the model lacks comes first, whatever the flag."""
    at = "Fragments in test chemical are {} the training set ranges".format
    said = F.when(inside, at("within")).when(~inside, at("NOT within"))
    return F.when(~all_in_model, "Have fragment in test chemical that is NOT included in the model").otherwise(said)


def with_query(url: Column, **params: Column) -> Column:
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.concat_ws("&", *pairs))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mgl_to_neg_log_molar(value: Column, weight: Column) -> Column:
    """mg/L to -log10(mol/L); null if either isn't positive."""
    molar = F.try_divide(value, weight * 1000)
    return F.when((value > 0) & (weight > 0), -F.log10(F.when(molar > 0, molar)))
