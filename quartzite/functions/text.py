"""Column builders for tolerant text fields: numbers, symbols, paths and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the usual form of a number.
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def floats(text: Column) -> Column:
    """All numbers of a text; NUL bytes count as blanks. A null text gives an empty array."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\0", " ")
    return F.transform(F.regexp_extract_all(clean, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.try_cast("double"))


def three_floats(text: Column) -> Column:
    """The first three numbers of a text, or null when it has fewer."""
    found = floats(text)
    return F.when(F.size(found) >= 3, F.slice(found, 1, 3))


def last_number(text: Column, pattern: str) -> Column:
    """The number captured by the last match of a pattern, or null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.get(found, F.size(found) - 1).try_cast("double")


def normal_symbol(text: Column) -> Column:
    """The leading letters of a species label, the first one a capital: 'mn_pv' gives 'Mn'."""
    head = F.regexp_extract(F.trim(text), r"^([A-Za-z]+)", 1)
    return F.nullif(F.initcap(head), F.lit(""))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def strain_percent(path: Column) -> Column:
    """The percentage of the first path part like V_+2.0%."""
    return F.nullif(F.regexp_extract(path, r"V_([-+]?[\d.]+)%", 1), F.lit("")).try_cast("double")


def compound(path: Column) -> Column:
    """The path part before the first part that starts with V_."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/V_[^/]*(?:/|$)", 1), F.lit(""))


def path_temperature(path: Column) -> Column:
    """Temperature from the path, for analysis: a whole part like 300K or 300 (either case), else the first number before a K."""
    whole = F.regexp_extract(path, r"(?i)(?:^|/)(\d+)\s*K?(?:/|$)", 1)
    part = F.regexp_extract(path, r"(?i)(\d+)\s*K", 1)
    return F.coalesce(F.nullif(whole, F.lit("")), F.nullif(part, F.lit(""))).try_cast("double")


def strict_path_temperature(path: Column) -> Column:
    """Temperature from the path, for preparation: only a whole part of digits and a capital K, for 3k can be a potassium content."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d+)K(?:/|$)", 1), F.lit("")).try_cast("double")


def strip_leading(text: Column, characters: str) -> Column:
    """Without leading characters of a set (not without a prefix)."""
    return F.ltrim(text, F.lit(characters))


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers of up to 20 digits."""
    padded = F.regexp_replace(text, r"(\d+)", "00000000000000000000$1")
    return F.lower(F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1"))


def header_value(comment: Column, key: str) -> Column:
    """The value of key=value or key="value" in a comment line; a longer key that ends alike does not count."""
    quoted = F.regexp_extract(comment, rf'(?i)(?:^|\s){key}="([^"]*)"', 1)
    plain = F.regexp_extract(comment, rf"(?i)(?:^|\s){key}=([^\s\"]+)", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")))


def property_offset(properties: Column, name: str) -> Column:
    """First column of a property in a Properties=name:type:n:... list, or null."""
    fields = F.split(properties, ":")
    triple = F.sequence(F.lit(0), F.floor(F.size(fields) / 3).cast("int") - 1)
    named = F.transform(triple, lambda i: F.struct(F.get(fields, 3 * i).alias("name"), F.get(fields, 3 * i + 2).try_cast("int").alias("n")))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.when(acc["found"], 0).otherwise(F.when(x["name"] == name, 0).otherwise(F.coalesce(x["n"], F.lit(0))))).alias("at"),
        (acc["found"] | (x["name"] == name)).alias("found"),
    )
    done = F.aggregate(named, F.struct(F.lit(0).alias("at"), F.lit(False).alias("found")), step)
    return F.when((F.size(fields) >= 3) & done["found"], done["at"])


def json_numbers(value: Column) -> Column:
    """The numbers of a JSON list, flat or of rows, with the mark _JSON before it or not; null where there is no such list."""
    body = F.trim(F.regexp_replace(F.trim(value), r"^_JSON\s*", ""))
    nested = F.flatten(F.from_json(body, "array<array<double>>"))
    return F.when(body.rlike(r"^\[\s*\["), nested).when(F.startswith(body, F.lit("[")), F.from_json(body, "array<double>"))


def matches_any(name: Column, parts: list[str]) -> Column:
    """Whether a name contains any of the parts, in either case."""
    return F.coalesce(F.lower(name).rlike("|".join(f"\\Q{p.lower()}\\E" for p in parts)) if parts else F.lit(False), F.lit(False))


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one; whole parts are compared."""
    found = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        found = found | (path == root) | F.startswith(path, F.lit(f"{root}/"))
    return F.coalesce(found, F.lit(False))


def categorise(text: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Category and subcategory of the first rule (pattern, category, subcategory) that matches; null where none does."""
    category, sub = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, c, s in reversed(rules):
        hit = text.rlike(pattern)
        category, sub = F.when(hit, c).otherwise(category), F.when(hit, s).otherwise(sub)
    return category, sub


def pair_key(a: Column, b: Column) -> Column:
    """A key of two names in either order."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))
