"""Column expressions over text: folding, keys, codes, ordered patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a road type and the canonical one.
ROAD_TYPES = {
    "C": "CARRER", "CL": "CARRER", "CARRER": "CARRER", "CALLE": "CARRER",
    "AV": "AVINGUDA", "AVD": "AVINGUDA", "AVGDA": "AVINGUDA", "AVINGUDA": "AVINGUDA",
    "PS": "PASSEIG", "PG": "PASSEIG", "PASSEIG": "PASSEIG", "PASEO": "PASSEIG",
    "PL": "PLACA", "PZ": "PLACA", "PLACA": "PLACA", "PLAZA": "PLACA",
    "RB": "RAMBLA", "RAMBLA": "RAMBLA",
    "PJ": "PASSATGE", "PTGE": "PASSATGE", "PASSATGE": "PASSATGE",
    "RD": "RONDA", "RONDA": "RONDA",
    "TR": "TRAVESSERA", "TRAVESSERA": "TRAVESSERA",
    "CR": "CARRETERA", "CTRA": "CARRETERA", "CARRETERA": "CARRETERA",
    "GV": "GRAN VIA", "VIA": "VIA", "BXDA": "BAIXADA", "BAIXADA": "BAIXADA",
}
# Words dropped from street names. The two-word ones never equal a single word.
PARTICLES = ["DE", "DEL", "DELS", "DE LA", "DE LES", "D", "LA", "EL", "ELS", "LES", "L"]
# Words that say nothing about which establishment a name means.
GENERIC_NAME_WORDS = ["HOTEL", "HOSTAL", "APARTAMENTS", "APARTAMENTOS", "BARCELONA", "THE", "DE", "LA"]
# Fixed value: registry numbers as they appear inside other text.
CODE_PATTERN = r"(?i)\b((?:HUTB|HCC|ATCC|HB|ATB)-?\d+)\b"
# Subtype of an establishment by name, first match wins.
SUBTYPES = [
    ("hostal", r"hostal|hostel|alberg"),
    ("pension", r"pensio|pension"),
    ("residencia", r"residencia|residence"),
    ("apartamentos", r"apartament|apartment|aparthotel|apartahotel|suites"),
]
# Hotel chains by name, first match wins.
CHAINS = [
    ("Catalonia", r"\bcatalonia\b|\btexfil\b"),
    ("H10", r"\bh10\b"),
    ("NH", r"\bnh\b"),
    ("Melia", r"\bmelia\b|\btryp\b"),
    ("HCC", r"\bhcc\b"),
    ("Eurostars", r"\beurostars\b|\bexe\b|\bhotusa\b"),
    ("Vincci", r"\bvincci\b"),
    ("Acta", r"\bacta\b"),
    ("Sercotel", r"\bsercotel\b"),
    ("Barcelo", r"\bbarcelo\b"),
    ("Abba", r"\babba\b"),
    ("Praktik", r"\bpraktik\b"),
    ("Chic & Basic", r"\bchic\s*(&|and)\s*basic\b"),
    ("Atiram", r"\batiram\b"),
    ("Derby", r"\bderby\b"),
    ("SB", r"\bsb\b"),
    ("Ibis / Accor", r"\bibis\b|\baccor\b|\bnovotel\b|\bmercure\b|\bsofitel\b"),
    ("Hilton", r"\bhilton\b|\bdoubletree\b"),
    ("Marriott", r"\bmarriott\b|\bac hotels\b|\bmoxy\b"),
    ("Ilunion", r"\bilunion\b|\bconfortel\b"),
    ("Hesperia", r"\bhesperia\b"),
    ("Silken", r"\bsilken\b"),
    ("Room Mate", r"\broom\s*mate\b"),
    ("Generator / Safestay", r"\bgenerator\b|\bsafestay\b"),
    ("Occidental / Ayre", r"\boccidental\b|\bayre\b"),
]
# Shop signs written in two ways.
BRAND_ALIASES = {"STARBUCKS COFFEE": "STARBUCKS"}
BRAND_REWRITES = [("MC DONALDS", "MCDONALDS")]
# District names as displayed.
DISTRICT_NAMES = {
    "SANT MARTI": "Sant Martí", "GRACIA": "Gràcia", "SARRIA-SANT GERVASI": "Sarrià-Sant Gervasi",
    "SANTS-MONTJUÏC": "Sants-Montjuïc", "HORTA-GUINARDÓ": "Horta-Guinardó",
}


@lru_cache(maxsize=2)
def _accent_pairs(form: str) -> tuple[str, str, dict[str, str]]:
    """From the Unicode decomposition rule, over all scripts: characters with one base character, those base
    characters, and what stands for characters with several. Korean syllables stay whole."""
    marked, plain, several = [], [], {}
    for point in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)):
        parts = unicodedata.normalize(form, chr(point))
        base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if base and base != chr(point):
            if len(base) == 1 and point < 0x10000:
                marked.append(chr(point))
                plain.append(base)
            else:
                several[chr(point)] = base
    return "".join(marked), "".join(plain), several


def let(value: Column, body) -> Column:
    """Binds a value once for a body that uses it several times, so the optimizer cannot copy the
    work into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_accents(text: Column, form: str = "NFD") -> Column:
    """Text without marks over or under its letters, in any script; ``form="NFKD"`` also opens ligatures and the like.

    Text of single-byte characters has nothing to strip and is passed through.
    """
    marked, plain, several = _accent_pairs(form)
    single = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), marked, plain)
    holds_several = F.length(F.translate(single, "".join(several), "")) < F.length(single)
    opened = F.when(holds_several, F.array_join(F.transform(F.split(single, ""), lambda c: _opened(c, form)), "")).otherwise(single)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(opened)


@lru_cache(maxsize=2)
def _pages(form: str) -> tuple[str, str]:
    """What stands for a character with several, in two levels: the place of each page of 256 code points (0: it holds
    none), and the entries of the pages; both as one literal that is split once."""
    several = _accent_pairs(form)[2]
    used = sorted({ord(k) >> 8 for k in several})
    places = [str(used.index(p) + 1) if p in used else "0" for p in range(max(used, default=0) + 1)]
    entries = [several.get(chr(page << 8 | low), "") for page in used for low in range(256)]
    return ",".join(places), "\x01".join(entries)


def _opened(letter: Column, form: str) -> Column:
    places, entries = (F.split(F.lit(x), sign) for x, sign in zip(_pages(form), (",", "\x01")))
    code = F.ascii(letter)
    page = F.coalesce(F.try_element_at(places, F.shiftright(code, 8) + 1).cast("int"), F.lit(0))
    entry = F.try_element_at(entries, (page - 1) * 256 + code.bitwiseAND(F.lit(255)) + 1)
    return F.when((page > 0) & (entry != ""), entry).otherwise(letter)


def strip_blanks(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fold_upper(text: Column) -> Column:
    """Upper case, no accents, signs become spaces; missing becomes the empty string."""
    folded = F.upper(strip_accents(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(folded, r"(?U)[^\w\s]", " ")


def fold_lower(text: Column) -> Column:
    """Lower case, no accents, trimmed; missing becomes the empty string."""
    return strip_blanks(F.lower(strip_accents(F.coalesce(text, F.lit("")), "NFKD")))


def name_key(text: Column) -> Column:
    """Letters and digits only, one space between runs."""
    return F.trim(F.regexp_replace(fold_lower(text), r"[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def lookup(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def street(road_type: Column, road_name: Column, types: Mapping[str, str] = ROAD_TYPES) -> Column:
    """Canonical street: the type may sit in either column, or in both."""
    both = F.concat_ws(" ", F.coalesce(road_type, F.lit("")), F.coalesce(road_name, F.lit("")))
    canon = lookup(types)

    def assemble(tokens: Column) -> Column:
        first = F.try_element_at(canon, F.try_element_at(tokens, F.lit(1)))
        second = F.try_element_at(canon, F.try_element_at(tokens, F.lit(2)))
        skip = F.when(first.isNull(), 0).when(second == first, 2).otherwise(1)
        rest = F.filter(
            F.slice(tokens, skip + 1, F.greatest(F.size(tokens), F.lit(1))),
            lambda w: ~w.isin(PARTICLES),
        )
        return F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.concat_ws(" ", rest)))

    return let(words(fold_upper(both)), assemble)


def first_number(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1)


def unit(text: Column) -> Column:
    """Floor or door without leading zeros, unless nothing else is left."""
    return let(
        F.trim(fold_upper(text)),
        lambda t: F.coalesce(F.nullif(F.regexp_replace(t, "^0+", ""), F.lit("")), t),
    )


def address_key(
    town: Column, road_type: Column, road_name: Column, number: Column,
    floor: Column | None = None, door: Column | None = None,
) -> Column:
    """Join key of an address; null when a mandatory part is missing, so it can never match."""
    must = F.array(F.trim(fold_upper(town)), street(road_type, road_name), first_number(number))
    units = [unit(c) for c in (floor, door) if c is not None]
    return let(must, lambda m: F.when(~F.array_contains(m, ""), F.concat_ws("|", m, *units)))


def name_similarity(a: Column, b: Column, generic: Sequence[str] = tuple(GENERIC_NAME_WORDS)) -> Column:
    """Shared words over the shorter word set, generic words aside; 0 when one side has none."""
    drop = F.array(*[F.lit(w) for w in generic])
    left, right = (F.array_except(words(fold_upper(c)), drop) for c in (a, b))

    def share(pair: Column) -> Column:
        shorter = F.least(F.size(pair["l"]), F.size(pair["r"]))
        shared = F.size(F.array_intersect(pair["l"], pair["r"]))
        return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))

    return let(F.struct(left.alias("l"), right.alias("r")), share)


def clean_code(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(text, r"\s+", "")), F.lit(""))


def embedded_code(text: Column, pattern: str = CODE_PATTERN) -> Column:
    code = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1))
    return F.nullif(F.regexp_replace(code, r"^([A-Z]+)(\d)", "$1-$2"), F.lit(""))


def postcode(text: Column) -> Column:
    digits = F.regexp_replace(F.split(text, r"\.").getItem(0), r"\D", "")
    return F.when(F.length(digits) > 5, digits).when(digits != "", F.lpad(digits, 5, "0"))


def first_label(text: Column, patterns: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first pattern found in the text."""
    chosen = F.when(F.lit(False), F.lit(""))
    for label, pattern in patterns:
        chosen = chosen.when(text.rlike(pattern), F.lit(label))
    return chosen.otherwise(F.lit(otherwise))


def both_names(name: Column, company: Column) -> Column:
    return F.concat_ws(" ", fold_lower(name), fold_lower(company))


def brand(
    text: Column, aliases: Mapping[str, str] = BRAND_ALIASES,
    rewrites: Sequence[tuple[str, str]] = tuple(BRAND_REWRITES),
) -> Column:
    plain = F.trim(F.regexp_replace(F.upper(strip_accents(text)), r"[^A-Z0-9& ]", ""))
    known = let(plain, lambda p: F.coalesce(F.try_element_at(lookup(aliases), p), p))
    for old, new in rewrites:
        known = F.replace(known, F.lit(old), F.lit(new))
    return F.nullif(known, F.lit(""))


def company(text: Column, marker: str = "no aplica") -> Column:
    """Company name without bracketed parts or loose punctuation; the personal marker is null."""
    bare = F.btrim(F.regexp_replace(text, r"\(.*?\)", ""), F.lit(" .,"))
    tidy = F.nullif(F.regexp_replace(F.upper(bare), r"\s+", " "), F.lit(""))
    return F.when(F.lower(F.trim(text)) != marker, tidy)


def identifier(text: Column) -> Column:
    return F.substring(F.lower(F.btrim(text, F.lit("{}"))), 1, 36)


def without_sentinel(text: Column, sentinel: str = "SN") -> Column:
    return F.when(F.upper(F.trim(text)) != sentinel, text)


def display_name(text: Column, names: Mapping[str, str] = DISTRICT_NAMES) -> Column:
    """The name as given, or with a capital after everything that is no letter."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    capital = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))))
    return F.coalesce(F.try_element_at(lookup(names), text), F.array_join(capital, ""))


def address_line(road_type: Column, road_name: Column, number: Column, town: Column) -> Column:
    road = F.trim(F.concat_ws(" ", F.coalesce(road_type, F.lit("")), F.coalesce(road_name, F.lit(""))))
    first = F.trim(F.split(F.coalesce(number, F.lit("")), "-").getItem(0))
    line = F.concat(road, F.lit(" "), first, F.lit(", "), F.trim(F.coalesce(town, F.lit(""))))
    return F.btrim(line, F.lit(" ,"))


def without_bracket_tail(text: Column) -> Column:
    return F.regexp_replace(text, r" \(.*\)", "")
