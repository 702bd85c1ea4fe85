"""Text of invoices and addresses: keys, names, labels, and fields found in document text.

Patterns use one dialect that Java and RE2 read alike: explicit white space, ASCII word boundaries, and explicit
classes for Turkish letters, since case folding of ı/I and i/İ is wanted nowhere.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and their comparison forms.
TURKISH_UPPER, TURKISH_LOWER = "Iİ", "ıi"
FOLDED_FROM, FOLDED_TO = "ÇĞIİÖŞÜçğıöşü", "cgiiosucgiosu"
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
NO_ADDRESS = "Adres okunamadı"

# Patterns of the fields, tried in order; what counts is the first group.
WS = r"[\s\x0b\p{Z}\x{feff}]"
_LEFT, _RIGHT = r"(?:^|[^0-9A-Za-z_])", r"(?:$|[^0-9A-Za-z_])"
DOC_NO = (
    rf"(?i)[Çç][ıi]k[ıi][Şş]{WS}*Belgesi{WS}*[:.]?{WS}*([0-9]{{6,12}})".replace("[ıi]", "[ı]"),
    rf"(?i){_LEFT}No\.{WS}*[:.]?{WS}*([0-9]{{7,12}}){_RIGHT}",
    rf"(?i)Teslimat{WS}*No{WS}*[:.]?{WS}*([0-9_]{{6,20}})",
    rf"(?i)Sipari[Şş]{WS}*No{WS}*[:.]?{WS}*([0-9_]{{6,20}})",
)
PHONE = r"((?:\+?90[\s\x0b\p{Z}\x{feff}-]?)?0?[\s\x0b\p{Z}\x{feff}]?5[0-9]{2}[\s\x0b\p{Z}\x{feff}-]?[0-9]{3}[\s\x0b\p{Z}\x{feff}-]?[0-9]{2}[\s\x0b\p{Z}\x{feff}-]?[0-9]{2})"
RECIPIENT = (rf"(?i)Al[ı]c[ı]{WS}*[:.]?{WS}*([^\n\r]{{3,60}})", rf"(?i)SAYIN{WS}*[\n\r]+{WS}*([^\n\r]{{3,60}})")
PRODUCT = rf"(?i)[Üü]r[üÜ]n{WS}*[:.]?{WS}*([^\n\r]{{3,70}})"
PIECES = rf"{_LEFT}([2-9]){WS}*/{WS}*[1-9]{_RIGHT}"
EDGES = rf"^{WS}+|{WS}+$"


def full(text: Column) -> Column:
    """Text, with an empty one as null."""
    return F.nullif(text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def phone_key(phone: Column) -> Column:
    """The last ten digits of a phone number; null with fewer."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, TURKISH_UPPER, TURKISH_LOWER))


def plain_name(name: Column) -> Column:
    """A name for comparison: lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(turkish_lower(name), "[^a-zçğıöşü0-9]+", " "))


def search_key(text: Column) -> Column:
    """Folded to ASCII letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, FOLDED_FROM, FOLDED_TO)), "[^a-z0-9]+", " "))


def address_line(quarter: Column, road: Column, door: Column, flat: Column, district: Column) -> Column:
    """The parts that are there, joined by a middle dot."""
    parts = [F.concat(full(quarter), F.lit(" Mh.")), full(road), F.concat(F.lit("No "), full(door)), F.concat(F.lit("D:"), full(flat)), full(district)]
    return F.coalesce(full(F.concat_ws(" · ", *parts)), F.lit(NO_ADDRESS))


def day_and_month(day: Column) -> Column:
    names = F.array(*map(F.lit, MONTHS))
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.get(names, F.month(day) - 1))


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, halves upwards."""
    scaled = F.floor(value * 10**digits + 0.5)
    size = F.abs(scaled)
    whole = F.floor(size / 10**digits).cast("bigint")
    sign = F.when(scaled < 0, "-").otherwise("")
    return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad((size - whole * 10**digits).cast("bigint").cast("string"), digits, "0"))


def pad_left(text: Column, width: int) -> Column:
    """Padded on the left; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def pad_right(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def first_match(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[full(F.regexp_extract(text, p, 1)) for p in patterns])


def document_number(text: Column) -> Column:
    return trimmed(first_match(text, *DOC_NO))


def phone(text: Column) -> Column:
    """The first run that reads like a mobile number, even inside longer digit runs."""
    return trimmed(first_match(text, PHONE))


def strict_phone(text: Column) -> Column:
    """The same, only where no digit stands before or after."""
    return trimmed(first_match(text, "(?:^|[^0-9])" + PHONE + "(?:$|[^0-9])"))


def recipient(text: Column) -> Column:
    return full(trimmed(F.regexp_replace(first_match(text, *RECIPIENT), rf"{WS}{{2,}}", " ")))


def product(text: Column) -> Column:
    return trimmed(first_match(text, PRODUCT))


def pieces(text: Column) -> Column:
    return F.coalesce(first_match(text, PIECES).cast("int"), F.lit(1))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), WS, ""))


def documents_of(text: Column) -> Column:
    """A text's documents, each beginning at a line with a document label; all of it, if it has at most one."""
    label = r"(?im)^(?=.*(?:Belgesi|Teslimat[ \t]*No|Sipari[Şş][ \t]*No)[ \t]*[:.]?[ \t]*[0-9_]{6})"
    return F.filter(F.transform(F.split(text, label), lambda x: trimmed(x)), lambda x: x != "")
