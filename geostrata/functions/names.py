"""String rules of catalogues and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small letters of the Cyrillic alphabet and their Latin spelling (fixed values); capitals take a capital first letter.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def norm(value: Column) -> Column:
    return F.lower(F.trim(value))


def norm_crs(value: Column) -> Column:
    """``epsg:n`` of EPSG:n, a URN or a bare number; 4326 for CRS84; null otherwise."""
    text = norm(value)
    code = F.regexp_extract(text, r"^(?:urn:ogc:def:crs:)?(?:epsg:(?:[^:]*:)?)?(\d{4,5})$", 1)
    return F.when(text.rlike(r"crs84$|^wgs ?84$"), "epsg:4326").when(code != "", F.concat(F.lit("epsg:"), code))


def slugify(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, "[^A-Za-z0-9_-]", "-"), F.lit("-")))


def transliterate(value: Column) -> Column:
    """Latin spelling in the same case; blanks and hyphens become _, of the rest letters, digits and _ stay."""
    both = LATIN | {k.upper(): v.capitalize() for k, v in LATIN.items()}
    single = {k: v for k, v in both.items() if len(v) == 1}
    out = F.translate(value, "".join(single) + " -", "".join(single.values()) + "__")
    for k, v in both.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"[^\p{L}\p{N}_]", "")


def fmt_bytes(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / 1024**k), F.lit(" " + unit))).otherwise(out)
    return out


def first_of(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose text occurs, else null."""
    out = F.lit(None).cast("string")
    for needle, value in reversed(rules):
        out = F.when(F.contains(text, F.lit(needle)), value).otherwise(out)
    return out
