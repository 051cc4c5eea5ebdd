"""Text cleaning, locale numbers, keys and urls as column expressions."""

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Title words that don't tell properties apart.
STOPWORDS = ("venta", "vende", "depto", "departamento")
#: Known spellings of communes by their match key.
COMUNAS = {
    "nunoa": "Ñuñoa", "nunoa santiago": "Ñuñoa", "providencia": "Providencia", "las condes": "Las Condes", "santiago": "Santiago", "santiago centro": "Santiago", "vitacura": "Vitacura", "la reina": "La Reina",
    "macul": "Macul", "la florida": "La Florida", "san miguel": "San Miguel", "recoleta": "Recoleta", "independencia": "Independencia", "penalolen": "Peñalolén", "penalolen santiago": "Peñalolén",
    "puente alto": "Puente Alto", "lo barnechea": "Lo Barnechea", "la dehesa": "Lo Barnechea", "maipu": "Maipú",
}
#: Lower-cased remains of UTF-8 that was read as Latin-1, once or twice, and what they stood for.
MOJIBAKE = {"ã¡": "a", "ã©": "e", "ã\xad": "i", "ã³": "o", "ãº": "u", "ã±": "n", "ã‘": "n", "ãƒâ€˜": "n", "ãƒâ±": "n"}
#: White space as in Unicode, and the four separators that Python counts with it.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: A text of characters up to U+00FF that are the bytes of valid UTF-8.
UTF8_BYTES = r"(?s)^(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2})*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def collapse(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; empty is null."""
    return F.nullif(collapse(c), F.lit(""))


@lru_cache(1)
def _decomposed() -> tuple[str, str, str, str]:
    """Compatibility decomposition without combining marks, by rule: characters, what single ones become, characters that become several, and what by their number as JSON.

    Characters whose decomposition is empty stand last, where translate() deletes them. Hangul stays composed.
    """
    single, gone, wide = {}, [], {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if plain == "":
            gone.append(chr(code))
        elif len(plain) > 1:
            wide[code] = plain
        elif plain != chr(code):
            single[chr(code)] = plain
    return "".join([*single, *gone]), "".join(single.values()), "".join(map(chr, wide)), json.dumps([wide.get(code) for code in range(max(wide) + 1)])


def strip_accents(c: Column) -> Column:
    """The text in compatibility decomposition without its combining marks."""
    characters, plain, wide, table = _decomposed()
    at = F.from_json(F.lit(table), "array<string>")
    long = lambda t: F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.get(at, F.ascii(x)), x)), "")
    # Most texts are plain; the longer decompositions (ligatures, fractions, ...) are asked for only where a text has one.
    # A text is looked through by translate(), whose cost is one look at each character however many are sought.
    marked = lambda t: F.translate(F.when(F.translate(t, wide, "") != t, long(t)).otherwise(t), characters, plain)
    return let(c, lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), marked(t)).otherwise(t))


def match_key(c: Column) -> Column:
    """Lower case without accents and with single blanks; null stays null."""
    return collapse(strip_accents(F.lower(collapse(c))))


def plain(text: str) -> str:
    """match_key() of a constant."""
    return " ".join("".join(x for x in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(x)).split())


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, read anew where the whole text is such."""
    pairs = [(bytes([b]).decode("cp1252", "ignore"), chr(b)) for b in range(0x80, 0xA0)]
    pairs = [(a, b) for a, b in pairs if a]
    western = lambda t: F.translate(t, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    read = lambda t: F.decode(F.encode(t, "ISO-8859-1"), "UTF-8")
    other = lambda t: let(western(t), lambda w: F.when(w.rlike(UTF8_BYTES), read(w)).otherwise(t))
    return let(c, lambda t: F.when(~t.rlike(r"[^\x00-\x7f]"), t).when(t.rlike(UTF8_BYTES), read(t)).otherwise(other(t)))


def comuna_key(c: Column) -> Column:
    """Lower case without accents, after repair of wrongly read UTF-8; null is ''."""
    text = repaired(F.lower(F.trim(c)))
    for bad, good in MOJIBAKE.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.coalesce(strip_accents(text), F.lit(""))


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def standard_comuna(c: Column) -> Column:
    """The known spelling, else title case; blank is null."""
    known = F.create_map(*[F.lit(x) for pair in COMUNAS.items() for x in pair])
    return let(clean_text(c), lambda text: F.coalesce(F.try_element_at(known, match_key(text)), title_case(text)))


def locale_number(c: Column) -> Column:
    """Numbers of text with dots for thousands and a comma for decimals; only positive ones."""
    digits = F.regexp_replace(F.translate(c, ",.", "."), r"[^0-9.-]", "")
    value = digits.try_cast("double")
    return F.when(value > 0, value)


def positive_number(df: DataFrame, name: str) -> Column:
    """A column's positive numbers: text as locale_number() reads it, numbers as they are."""
    if df.schema[name].dataType == T.StringType():
        return locale_number(F.col(name))
    return F.when(F.col(name) > 0, F.col(name).cast("double"))


def _point(c: Column) -> Column:
    return F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def positive_int(c: Column) -> Column:
    """A positive number with comma or dot decimals, cut to a whole number."""
    value = _point(c).cast("int")
    return F.when(value > 0, value)


def non_negative_int(c: Column) -> Column:
    value = _point(c).cast("int")
    return F.when(value >= 0, value)


def float_or_null(c: Column) -> Column:
    return _point(c)


def price_text(c: Column) -> tuple[Column, Column]:
    """(CLP, UF) of a price text: 'uf' makes it UF, '$' or 'clp' CLP."""
    low, value = F.lower(c), locale_number(c)
    uf = F.contains(low, F.lit("uf"))
    return F.when(~uf & (F.contains(low, F.lit("$")) | F.contains(low, F.lit("clp"))), value.cast("bigint")), F.when(uf, value)


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case and the path without its last slashes (a path of slashes alone stays); the rest is dropped."""
    url = collapse(c)
    scheme, host, path = (F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", i) for i in (1, 2, 3))
    bare = F.regexp_replace(path, r";[^/]*$", "")
    bare = F.coalesce(F.nullif(F.regexp_replace(bare, "/+$", ""), F.lit("")), bare)
    joined = F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""), bare)
    return F.when(url != "", joined)


def source_id(url: Column) -> Column:
    """The first MLC id or number of five or more digits of a url."""
    return F.nullif(F.regexp_extract(url, r"(?i)(MLC[-_]?[0-9]+|[0-9]{5,})", 1), F.lit(""))


def last_number_or_slug(url: Column) -> Column:
    """The last number of five or more digits in a url's path, else the path's last part."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(path, F.lit(r"([0-9]{5,})"), 1), F.lit(-1)), F.nullif(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]+)$", 1), F.lit("")))


def rounded_m2(m2: Column, step: int = 5) -> Column:
    """The nearest multiple of ``step``, halves to even."""
    return (F.bround(m2 / step) * step).cast("int")


def title_key(title: Column) -> Column:
    """The first six telling words of a title, joined by '-'."""
    telling = F.filter(F.split(collapse(comuna_key(title)), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return F.nullif(F.array_join(F.slice(telling, 1, 6), "-"), F.lit(""))


def fingerprint() -> Column:
    """comuna|m2|d|b|p|title key with x for unknown; null without comuna or a positive area."""
    known = lambda tag, c: F.concat(F.lit(f"{tag}:"), F.coalesce(F.col(c).cast("string"), F.lit("x")))
    comuna, m2 = F.nullif(comuna_key(F.col("comuna")), F.lit("")), F.when(F.col("m2_construidos") > 0, rounded_m2(F.col("m2_construidos")))
    parts = [comuna, F.concat(F.lit("m2:"), m2.cast("string")), known("d", "dormitorios"), known("b", "banos"), known("p", "estacionamientos"), F.concat(F.lit("t:"), title_key(F.col("titulo")))]
    return F.when(comuna.isNotNull() & m2.isNotNull(), F.concat_ws("|", *parts))
