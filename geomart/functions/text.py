"""Text and code-mapping expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source system's published code lists).
# Transit route_type: standard codes, then extended vehicle-type code ranges.
# Each entry is (low, high, label); a single code has low == high.
ROUTE_TYPE_LABELS = [
    (0, 0, "tram"),
    (1, 1, "subway"),
    (2, 2, "rail"),
    (3, 3, "bus"),
    (4, 4, "ferry"),
    (5, 5, "cable_tram"),
    (6, 6, "aerial_lift"),
    (7, 7, "funicular"),
    (11, 11, "trolleybus"),
    (12, 12, "monorail"),
    (100, 199, "rail"),
    (200, 299, "coach"),
    (400, 405, "subway"),
    (700, 799, "bus"),
    (800, 800, "trolleybus"),
    (900, 999, "tram"),
    (1000, 1099, "water_transport"),
    (1100, 1199, "air"),
    (1200, 1200, "ferry"),
    (1300, 1399, "aerial_lift"),
    (1400, 1400, "funicular"),
    (1500, 1599, "taxi"),
    (1700, 1799, "miscellaneous"),
]

# Territorial-authority name fixes: source spelling -> official register name.
TA_NAME_FIXES = [
    ("Queenstown Lakes District", "Queenstown-Lakes District"),
    ("Thames Coromandel District", "Thames-Coromandel District"),
    ("Matamata Piako District", "Matamata-Piako District"),
    ("Otorohanga District", "Ōtorohanga District"),
    ("Opotiki District", "Ōpōtiki District"),
    ("MacKenzie District", "Mackenzie District"),
    ("Central Hawkes Bay District", "Central Hawke's Bay District"),
    ("Chatham Islands", "Chatham Islands Territory"),
]

# Amenity categories: ordered (tag key, tag value, category); first match wins.
AMENITY_TAGS = [
    ("shop", "supermarket", "supermarket"),
    ("amenity", "supermarket", "supermarket"),
    ("amenity", "hospital", "hospital"),
    ("amenity", "school", "school"),
    ("amenity", "college", "school"),
    ("amenity", "university", "school"),
    ("amenity", "kindergarten", "early_childhood"),
    ("amenity", "childcare", "early_childhood"),
    ("amenity", "pharmacy", "pharmacy"),
    ("amenity", "clinic", "gp_clinic"),
    ("amenity", "doctors", "gp_clinic"),
    ("leisure", "park", "park"),
    ("amenity", "library", "library"),
]

# Field-alias patterns of the survey dictionary.
ALIAS_PATTERNS = {
    "census_year": r"Year:\s*(\d{4})",
    "measure": r"Measure:\s*([^,]+)",
    "variable_l1": r"Var1:\s*([^(]+)",
    "variable_l2": r"Var2:\s*([^(]+)",
    "category": r"\(([^)]+)\)\s*$",
}
# ---------------------------------------------------------------------------


def route_type_label(code: Column | str) -> Column:
    """Code -> label with ranges; NULL and unmatched codes -> 'unknown' (P9)."""
    c = (F.col(code) if isinstance(code, str) else code).try_cast("int")
    expr = F.when(c.isNull(), "unknown")
    for lo, hi, label in ROUTE_TYPE_LABELS:
        expr = expr.when(c == lo if lo == hi else c.between(lo, hi), label)
    return expr.otherwise("unknown")


def route_type_label_sql(code: str) -> str:
    parts = [f"WHEN TRY_CAST({code} AS INTEGER) IS NULL THEN 'unknown'"]
    for lo, hi, label in ROUTE_TYPE_LABELS:
        cond = f"= {lo}" if lo == hi else f"BETWEEN {lo} AND {hi}"
        parts.append(f"WHEN TRY_CAST({code} AS INTEGER) {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def canonical_ta_name(name: Column | str) -> Column:
    """Apply the fixed name fixes, else pass the name through (P10)."""
    n = F.col(name) if isinstance(name, str) else name
    expr = None
    for src, dst in TA_NAME_FIXES:
        expr = F.when(n == src, dst) if expr is None else expr.when(n == src, dst)
    return expr.otherwise(n)


def canonical_ta_name_sql(name: str) -> str:
    esc = lambda s: s.replace("'", "''")
    whens = " ".join(f"WHEN '{esc(s)}' THEN '{esc(d)}'" for s, d in TA_NAME_FIXES)
    return f"CASE {name} {whens} ELSE {name} END"


def amenity_category(props: dict[str, Column]) -> Column:
    """First matching category over the ordered tag list; NULL if none.

    ``props`` maps a tag key to the column holding that tag's value.
    """
    expr = None
    for key, value, cat in AMENITY_TAGS:
        if key not in props:
            continue
        cond = props[key] == value
        expr = F.when(cond, cat) if expr is None else expr.when(cond, cat)
    return expr


def amenity_category_sql(props: dict[str, str]) -> str:
    whens = " ".join(
        f"WHEN {props[k]} = '{v}' THEN '{c}'" for k, v, c in AMENITY_TAGS if k in props
    )
    return f"CASE {whens} END"


def normalise_feature_id(*candidates: Column) -> Column:
    """First present id; bare ids (no '/') are taken as nodes."""
    raw = F.coalesce(*[c.cast("string") for c in candidates])
    return F.when(raw.isNull(), None).when(raw.contains("/"), raw).otherwise(F.concat(F.lit("node/"), raw))


def parse_alias(alias: Column | str) -> dict[str, Column]:
    """Five regex extracts of a survey field alias (A5); year as INT."""
    a = F.col(alias) if isinstance(alias, str) else alias
    out = {k: F.regexp_extract(a, p, 1) for k, p in ALIAS_PATTERNS.items()}
    out["census_year"] = F.nullif(out["census_year"], F.lit("")).try_cast("int")
    return out


def feed_date(text: Column | str) -> Column:
    """``20240131`` -> date; null where the text is no such date."""
    return F.try_to_date(F.trim(F.col(text) if isinstance(text, str) else text), "yyyyMMdd")


def report_month(text: Column | str) -> Column:
    """``January 2024`` -> first day of the month; null where it is no month."""
    month = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.try_to_date(F.concat(F.lit("01 "), month), "dd MMMM yyyy")


def path_part(path: Column | str, pattern: str) -> Column:
    """First group of ``pattern`` in a file path; NULL when absent."""
    p = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
