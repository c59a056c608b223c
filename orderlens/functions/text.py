"""Parsers of product and specialty descriptions, all as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, lookup

# Product form codes found in item descriptions.
FORM_CODES = (
    "TAB", "TABS", "TABLET", "TABLETS", "CAP", "CAPS", "CAPSULE", "CAPSULES",
    "GCAP", "CPLT", "CAPLET", "CAPLETS", "LOZ", "LOZENGE", "LOZENGES",
    "SYRP", "SYRUP", "ELXR", "ELIXIR", "SUSP", "SUSPENSION",
    "POWD", "PWDR", "POWDER", "GRANULES", "CHEW",
    "CRM", "CR", "CREAM", "CREAMS", "OINT", "OINTMENT", "LOT", "LOTION",
    "GEL", "PASTE", "PDR", "PATCH", "PATCHES",
    "STICK", "BAR", "FT", "SHMP", "SHAMPOO", "FOAM",
    "INJ", "INJECTION", "INJECTIONS", "SDV", "MDV", "VL", "VIAL", "VIALS",
    "AMP", "AMPULE", "AMPULES", "PFS", "PF",
    "SOL", "SOLN", "SOLUTION", "SOLUTIONS", "IV", "IRRG", "IRR", "IRRIGATION",
    "LIQ", "LIQUID", "LIQUIDS", "SOLU", "CONCENTRATE",
    "INH", "INHALER", "NEB", "NEBULIZER", "NEBULIZED",
    "SPRY", "SPRAY", "AER", "AEROSOL", "MDI", "DPI",
    "SUPP", "SUPPOSITORY", "SUPPOSITORIES", "ENEMA",
    "DROPS", "DROP", "EYE", "OPHT", "OPHTHALMIC",
    "PLEDGET", "PLEDGETS",
    "WIPE", "WIPES", "PAD", "PADS", "SWAB", "SWABS",
    "STRIP", "STRIPS", "SHEET", "SHEETS", "ROLL", "ROLLS",
    "KIT", "KITS", "TRAY", "TRAYS", "SET", "SETS",
)
# Spelling of a form code -> the code it counts as.
FORM_NORMAL = {
    "CREAM": "CRM", "CREAMS": "CRM", "CR": "CRM",
    "OINTMENT": "OINT",
    "LOTION": "LOT",
    "TABLET": "TAB", "TABLETS": "TAB", "TABS": "TAB",
    "CAPSULE": "CAP", "CAPSULES": "CAP", "CAPS": "CAP", "GCAP": "CAP",
    "CPLT": "CAP", "CAPLET": "CAP", "CAPLETS": "CAP",
    "LOZENGE": "LOZ", "LOZENGES": "LOZ",
    "SYRUP": "SYRP",
    "ELIXIR": "ELXR",
    "SUSPENSION": "SUSP",
    "POWDER": "POWD", "PWDR": "POWD",
    "VIAL": "VL", "VIALS": "VL",
    "AMPULE": "AMP", "AMPULES": "AMP",
    "SOLUTION": "SOL", "SOLUTIONS": "SOL", "SOLN": "SOL", "SOLU": "SOL",
    "LIQUID": "LIQ", "LIQUIDS": "LIQ",
    "INHALER": "INH",
    "NEBULIZER": "NEB", "NEBULIZED": "NEB",
    "SPRAY": "SPRY",
    "AEROSOL": "AER",
    "SUPPOSITORY": "SUPP", "SUPPOSITORIES": "SUPP",
    "OPHTHALMIC": "OPHT",
    "INJECTION": "INJ", "INJECTIONS": "INJ",
    "IRRIGATION": "IRR", "IRRG": "IRR",
    "WIPES": "WIPE", "PADS": "PAD", "SWABS": "SWAB", "STRIPS": "STRIP",
    "SHEETS": "SHEET", "ROLLS": "ROLL", "KITS": "KIT", "TRAYS": "TRAY", "SETS": "SET",
}


def product_type(description: str | Column) -> Column:
    """First word before the first comma, cut at ``+`` or ``/``."""
    head = F.upper(F.trim(F.split_part(F.coalesce(col(description), F.lit("")), F.lit(","), F.lit(1))))
    return F.regexp_extract(head, r"^([^\s+/]*)", 1)


def form_code(description: str | Column) -> Column:
    """First known form token of the description, in its normal spelling; '' if none."""
    words = F.split(F.regexp_replace(F.upper(F.coalesce(col(description), F.lit(""))), r"[,/\s]+", " "), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.()\[\]0-9]+|[.()\[\]0-9]+$", ""))
    hit = F.get(F.filter(bare, lambda w: w.isin(*FORM_CODES)), 0)
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(FORM_NORMAL.items())])
    return F.coalesce(F.element_at(names, hit), hit, F.lit(""))


def matching_category(sub: Column | str, group: Column | str, category: Column | str) -> Column:
    return F.coalesce(col(sub), col(group), col(category), F.lit("UNKNOWN_CATEGORY"))


# Size, dose and pack patterns that tell variants of one product apart.
VARIANT_PATTERNS = (
    r"""\b\d+\s*(?:x|×|by)\s*\d+\s*(?:inch|inches|in|cm|mm|ft|"|'|ply)?\b""",
    r"""\b\d+(?:\.\d+)?\s*(?:inch|inches|in|cm|mm|ft|m|"|')\b""",
    r"""\b\d+(?:\.\d+)?\s*(?:mg|mcg|μg|ug|g|kg|ml|l|cc|fl\s*oz|oz|iu|units?)\b""",
    r"""\b\d+\s*/\s*(?:box|bx|case|cs|pack|pk|tray|tr|sleeve|bag|carton|ctn|each|ea)\b""",
    r"""\b(?:box|case|pack|tray|sleeve|bag|carton)\s+of\s+\d+\b""",
    r"""\b\d+\s*(?:ct|count|pk|pack|each|ea)\b""",
    r"""\b\d+\s*(?:pads?|wipes?|sheets?|tabs?|tablets?|capsules?|tubes?|rolls?|sponges?|swabs?|gloves?|masks?|gowns?)\b""",
    r"""\b(?:xxl|xl|xs|sm|sml|md|lg|small|medium|large|x-?large|x-?small)\b""",
    r"""\bsize\s*\d+\b""",
)
# Leftovers removed after the patterns above.
VARIANT_REST = (r"\s+\d+\s*$", r"\s+,\s+")


def variant_stem(description: str | Column) -> Column:
    s = F.coalesce(col(description), F.lit(""))
    for p in VARIANT_PATTERNS + VARIANT_REST:
        s = F.regexp_replace(s, "(?i)" + p, " ")
    s = F.trim(F.regexp_replace(s, r"[\s,]+", " "))
    return F.lower(F.regexp_replace(s, r"^[\s,\-|/]+|[\s,\-|/]+$", ""))


def variant_label(description: str | Column) -> Column:
    d = F.coalesce(col(description), F.lit(""))
    found = F.array(*[F.trim(F.regexp_extract(d, "(?i)" + p, 0)) for p in VARIANT_PATTERNS])
    found = F.filter(found, lambda x: x != "")
    lowered = F.transform(found, F.lower)
    unique = F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.when(F.size(unique) == 0, d).otherwise(F.array_join(unique, " • "))


def variant_group_key(item: Column | str, description: Column | str, family: Column | str,
                      category: Column | str, private: Column | str) -> Column:
    stem = variant_stem(description)
    return F.when(F.length(stem) < 4, F.concat(F.lit("solo:"), col(item).cast("string"))).otherwise(
        F.concat_ws("|", F.lower(F.coalesce(col(family), F.lit(""))),
                    F.lower(F.coalesce(col(category), F.lit(""))),
                    F.when(col(private) == 1, "1").otherwise("0"), stem))


# Archetype -> words of a specialty description, most specific first.
ARCHETYPE_WORDS = (
    ("government", ("GOVT", "GOVERNMENT", "HOMELAND", "MILITARY", "VA HOSPITAL", " VA ",
                    "DEPT OF DEFENSE", "DOD", "FEDERAL", "STATE OF ", "COUNTY OF ", "SHERIFF")),
    ("marketplace_reseller", ("AMAZON", "MARKETPLACE", "RESELLER", "WHOLESALE", "DISTRIBUT")),
    ("home_infusion", ("HOME INFUSION", "INFUSION PHARMACY", "INFUSION CARE")),
    ("home_care_provider", ("HOME MEDICAL", "HOME HEALTH", "HOME HOSPICE", "HOSPICE", "HOME CARE")),
    ("hospital_acute", ("HOSPITAL", "MEDICAL CENTER", "ACUTE CARE", "EMERGENCY MEDICINE", "EMERGENCY DEPT")),
    ("skilled_nursing", ("SKILLED", "NURSING HOME", "ASSISTED LIVING", "LONG TERM",
                         "NURSING FACILITY", "INTERMEDIATE CARE", "ALF ")),
    ("surgery_center", ("SURGERY CENTER", "AMBULATORY SURG", "SURGICAL CENTER",
                        "GENERAL SURGERY", "PLASTIC SURGERY")),
    ("lab_pathology", ("REFERENCE LAB", "HOSPITAL LAB", "PATHOLOGY", "DIAGNOSTIC LAB", "CLINICAL LAB")),
    ("veterinary", ("VETERIN", " VET ", "ANIMAL HOSP")),
    ("educational", ("EDUCATIONAL", "UNIVERSITY", "COLLEGE", "SCHOOL", "RESEARCH")),
    ("pharmacy", ("PHARMACY", "PHARMACEUTICAL", "RETAIL PHARM")),
    ("multispecialty_group", ("MULTIPLE SPECIALTY", "MULTI-SPECIAL", "GROUP PRACTICE", "GROUP PRACT")),
    ("community_health", ("COMMUNITY HEALTH", "FQHC", "FEDERALLY QUAL")),
    ("pediatric", ("PEDIATRIC", "CHILDREN", "NEONATAL")),
    ("primary_care", ("FAMILY PRACTICE", "FAMILY MEDICINE", "INTERNAL MED", "GENERAL PRAC", "FAMILY MED")),
)
# Archetype -> specialty codes; the market code AC comes before all of them.
ARCHETYPE_CODES = (
    ("skilled_nursing", ("HIA", "SKL")),
    ("home_care_provider", ("HMC", "HMH")),
    ("home_infusion", ("HMI", "INF")),
    ("surgery_center", ("GS", "OPS", "ORT", "URO", "OTO", "OPH", "PLS", "NSG")),
    ("primary_care", ("FP", "IM", "GP")),
    ("pediatric", ("PED", "NEO")),
    ("multispecialty_group", ("M01", "M08", "MUL")),
    ("community_health", ("COMHC", "FQHC", "RHC")),
    ("government", ("VA", "DOD", "FED", "PRS")),
    ("educational", ("EDU", "SCH", "COL", "UNV")),
    ("pharmacy", ("RX", "PHM", "RXP")),
    ("lab_pathology", ("PTH", "LAB", "CYT")),
    ("veterinary", ("VET", "ANM")),
    ("marketplace_reseller", ("FBA", "MKT", "X")),
)


def _contains_any(text: Column, words) -> Column:
    cond = text.contains(words[0])
    for w in words[1:]:
        cond = cond | text.contains(w)
    return cond


def archetype_by_description(description: str | Column, words=ARCHETYPE_WORDS) -> Column:
    d = col(description)
    text = F.upper(F.trim(d))
    out = F.when(d.isNull() | (d == ""), "unknown")
    for code, keys in words:
        out = out.when(_contains_any(text, keys), code)
    return out.otherwise("specialty_clinic")


def archetype_by_code(code: str | Column, description: str | Column, market: str | Column,
                      codes=ARCHETYPE_CODES, acute_market: str = "AC") -> Column:
    c = F.upper(F.trim(F.coalesce(col(code), F.lit(""))))
    d = F.upper(F.trim(F.coalesce(col(description), F.lit(""))))
    m = F.upper(F.trim(F.coalesce(col(market), F.lit(""))))
    out = F.when((c == "") & (d == ""), "unknown").when(m == acute_market, "hospital_acute")
    for name, keys in codes:
        out = out.when(c.isin(*keys) | _contains_any(d, keys), name)
    return out.otherwise("specialty_clinic")


def display_name(segment: str | Column, markets: dict, sizes: dict) -> Column:
    """'PO_large' -> 'Physician Office, Large'."""
    s = col(segment)
    market, size = F.split_part(s, F.lit("_"), F.lit(1)), F.regexp_extract(s, "^[^_]*_(.*)$", 1)
    named = F.concat(lookup(market, markets, market), F.lit(", "), lookup(size, sizes, size))
    return F.when(s == "", F.lit(None)).when(s.contains("_"), named).otherwise(s)
