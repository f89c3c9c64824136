"""Cell cleaning and conversion as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from csvharbor.specs import FieldSpec, FieldType

# The characters with the Unicode White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Words read as booleans.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

# The 50 states and their codes.
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA",
    "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}

TWO_DIGIT_YEAR_WINDOW = 20
NUMERIC_TYPE = "decimal(28,10)"
_IGNORED = "$\u20ac\u00a3,"  # in numbers


def trim(c: Column) -> Column:
    """Both ends, all Unicode white space."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def _unwrap(c: Column) -> Column:
    return F.when(c.startswith("="), F.regexp_replace(c, r'(?s)^=(?:"(.*)"\z)?', "$1")).otherwise(c)


def _unquote(c: Column) -> Column:
    return F.btrim(c, F.lit("\"'"))


def _unprefix(c: Column) -> Column:
    return F.when(c.startswith("netsuite:"), F.substring(c, 10, 2**31 - 1)).otherwise(c)


# In this order: ``="x"`` or a leading ``=``, outer quotes, a ``netsuite:`` prefix; no second trim.
_CLEANING = (trim, _unwrap, _unquote, _unprefix)


def clean_cell(c: Column) -> Column:
    """Undo spreadsheet wrappers."""
    for step in _CLEANING:
        c = step(c)
    return c


def clean_cells(cells: Column) -> Column:
    """The same for an array of cells, step by step, so that no step's result is worked out twice."""
    for step in _CLEANING:
        cells = F.transform(cells, step)
    return cells


def may_need_cleaning(raw: Column) -> Column:
    """False for ASCII record text in which no cell can have a wrapper or white space other than blanks."""
    odd = F.octet_length(raw) != F.length(raw)
    for mark in ('"', "'", "=", "netsuite:", *WHITE_SPACE[:5]):
        odd = odd | raw.contains(mark)
    return odd


def clean_record(raw: Column, cells: Column) -> Column:
    """Cleaned cells of a record; most records need no more than blanks removed, which costs next to nothing."""
    return F.when(may_need_cleaning(raw), clean_cells(cells)).otherwise(F.transform(cells, lambda c: F.btrim(c)))


def trim_record(raw: Column, cleaned: Column) -> Column:
    """Cleaned cells without outer white space, which only cells in quotes still have."""
    return F.when(may_need_cleaning(raw), F.transform(cleaned, trim)).otherwise(cleaned)


def to_text(c: Column, trimmed: bool = False) -> Column:
    return F.nullif(c if trimmed else trim(c), F.lit(""))


def _plain_number(t: Column) -> Column:
    """ASCII text that starts like a number and has neither commas nor an exponent: a cast alone reads it."""
    starts = F.ascii(t).between(ord("+"), ord("9"))
    odd = t.contains(",") | t.contains("e") | t.contains("E")
    return starts & ~odd & (F.octet_length(t) == F.length(t))


def to_numeric(c: Column, trimmed: bool = False) -> Column:
    """Currency signs and thousands commas dropped, ``(x)`` negative, exponents refused."""
    t = c if trimmed else trim(c)
    return F.coalesce(F.when(_plain_number(t), t.try_cast(NUMERIC_TYPE)), number_text(t).try_cast(NUMERIC_TYPE))


def number_text(t: Column) -> Column:
    """Trimmed text as sign, digits and point only; empty where it is not a number."""
    bare = lambda c: F.translate(c, _IGNORED, "")
    marked = F.regexp_replace(t, r"(?s)^\((.*)\)\z", "\x01$1")
    signed = F.when(t.contains("(") | t.contains("\x01"), F.regexp_replace(bare(marked), r"(?U)^\x01\s*", "-")).otherwise(bare(t))
    return F.regexp_extract(trim(signed), r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)\z", 0)


def number_too_long(c: Column) -> Column:
    """True for a number with more than 18 digits before the point or ten behind it: the stored type would lose some.

    Such a number has twelve characters without its signs, so most texts need no look at their digits.
    """
    long = (F.length(c) > 10) & (F.length(F.translate(c, _IGNORED, "")) > 11)
    return long & F.coalesce(number_text(trim(c)).rlike(r"^[+-]?0*[1-9]\d{18}|\.\d{10}\d*[1-9]"), F.lit(False))


def _iso(c: Column, *rewrites: tuple[str, str]) -> Column:
    for pattern, iso in rewrites:
        c = F.regexp_replace(c, pattern, "@" + iso)
    return F.regexp_extract(c, "^@(.+)$", 1).try_cast("date")


def to_date(c: Column, as_of_year: int, trimmed: bool = False) -> Column:
    """Month-first and ISO shapes with four-digit years, then two-digit years around a moving pivot."""
    t = c if trimmed else trim(c)
    is_iso = (F.length(t) == 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    numeric = _iso(
        t,
        (r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})\z", "$4-$1-$3"),
        (r"^(\d{4})([/.-]?)(\d{2})\2(\d{2})\z", "$1-$3-$4"),
    )
    spaced = F.regexp_replace(t, " +", " ")
    named = F.coalesce(F.try_to_date(spaced, "MMM d, yyyy"), F.try_to_date(spaced, "d MMM yyyy"))
    short = _iso(t, (r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{2})\z", "20$4-$1-$3"))
    latest = min(as_of_year + TWO_DIGIT_YEAR_WINDOW, 2068)
    pivoted = F.when(F.year(short) > latest, F.add_months(short, -1200)).otherwise(short)
    other = F.coalesce(F.when(t.rlike("[A-Za-z]{3}"), named).otherwise(numeric), pivoted)
    return F.when(is_iso, t.try_cast("date")).otherwise(other)


def to_bool(c: Column, trimmed: bool = False) -> Column:
    word = F.lower(c if trimmed else trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("int"))


_DASHED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def to_uuid(c: Column) -> Column:
    """Plain, braced, URN or undashed form to the canonical one; anything else NULL."""
    low = F.lower(c)
    digits = F.regexp_replace(low, "^urn:uuid:|[{}-]", "")
    dashed = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(low.rlike(rf"^(?:(?:urn:uuid:)?{_DASHED}|\{{{_DASHED}\}}|[0-9a-f]{{32}})\z"), dashed)


def uuid_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_us_state(c: Column) -> Column:
    """Full name or any-case code to the code; other text trimmed and kept."""
    by_name = F.create_map(*[F.lit(v) for pair in US_STATES.items() for v in pair])
    t = trim(c)
    code = F.upper(t)
    return F.coalesce(
        F.try_element_at(by_name, F.lower(t)),
        F.when(code.isin(*US_STATES.values()), code),
        t,
    )


def convert(c: Column, spec: FieldSpec, as_of_year: int, trimmed: bool = False) -> Column:
    """Cleaned text to the field's stored type; text that does not convert becomes NULL."""
    if spec.type is FieldType.DATE:
        return to_date(c, as_of_year, trimmed)
    if spec.type is FieldType.NUMERIC:
        return to_numeric(c, trimmed)
    if spec.type is FieldType.BOOL:
        return to_bool(c, trimmed)
    return F.coalesce(c, F.lit("")) if spec.not_null else to_text(c, trimmed)


def normalized(c: Column, spec: FieldSpec) -> Column:
    """The field's normalizer on non-blank text only."""
    if spec.normalizer is None:
        return c
    return F.when(c != "", spec.normalizer(c)).otherwise(c)


# One character per byte: well-formed UTF-8 sequences, then one byte that starts none.
_BAD_BYTE = (
    r"\G((?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2})*+)[\x80-\xFF]"
)


def repair_utf8(c: Column, replacement: str = "\ufffd") -> Column:
    """Every byte that is not part of valid UTF-8 becomes the replacement character."""
    bytewise = replacement.encode("utf-8").decode("latin-1")
    fixed = F.regexp_replace(F.decode(c.cast("binary"), "ISO-8859-1"), _BAD_BYTE, "$1" + bytewise)
    return F.when(F.is_valid_utf8(c), c).otherwise(F.encode(fixed, "ISO-8859-1").cast("string"))


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^\ufeff", "")


def ip_host(c: Column) -> Column:
    """Host part of ``host:port``; NULL unless it is an IPv4 or IPv6 address."""
    host = F.regexp_replace(F.regexp_replace(c, r"^([0-9.]+):\d+$", "$1"), r"^\[([^\]]*)\]:\d+$", "$1")
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(host.rlike(rf"^(?:{octet}\.){{3}}{octet}$") | host.rlike(r"^(?=[^:]*:[^:]*:)[0-9A-Fa-f:.]+(?:%\w+)?$"), host)
