"""Rooms, areas, prices and communes from free text, as column expressions.

What may or may not stand around a number is said by lookarounds, so that the first match is the answer, and the order
of a list of patterns says which of several answers counts. Texts are match keys: lower case, no accents, single blanks.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let, locale_number, match_key, plain

#: Words for rooms, and the numbers that are believed.
WORDS = {"dormitorios": r"(?:dormitorios?|dorms?|dorm|habitaciones?|hab)", "banos": r"(?:banos?|bano)", "estacionamientos": r"(?:estacionamientos?|estac\.?|est)"}
BELIEVED = {"dormitorios": "0?[1-6]", "banos": "0?[1-5]", "estacionamientos": "0?[0-6]"}
#: Compact forms such as 2D/2B/1E and 2B/1E.
COMPACT = r"\b([1-6]) ?d ?/? ?([1-5]) ?b(?: ?/? ?([0-6]) ?e)?\b"
COMPACT_BATHS = r"\b([1-5]) ?b ?/? ?([0-6]) ?e\b"
#: What says that a parking place is optional.
OPTIONAL = "opcion|opcional|posibilidad"
OPTIONAL_PARKING = (rf"\b(?:{OPTIONAL})(?: de)? ?(\d{{1,2}})? ?(?:estacionamientos?|estac\.?)\b", r"\b(?:estacionamientos?|estac\.?) ?(?:opcional|disponible|con opcion)\b")
#: Forms of an area, by how sure they are.
SURE = (r"(\d{2,})\s?m2", r"(\d{2,})\s?m²", r"(\d{2,})\s?mts2", r"(\d{2,})\s?metros cuadrados")
LIKELY = (r"superficie\s?:?\s?(\d{2,})", r"construidos?\s?:?\s?(\d{2,})", r"(\d{2,})\s?m\b")
#: Words near a number that make it a price.
MONEY = (r"\$", "clp", "uf", "precio", "valor")
#: Units and labels of areas; the labels by their worth.
UNIT = r"(?:m ?(?:2|\?)|mt2|mts2?|mtrs?|metros? ?cuadrados?)"
USEFUL, BUILT, PLAIN, TOTAL = r"(?:util(?:es)?|superficie util)", r"(?:construid[ao]s?|superficie construid[ao])", r"(?:superficie|sup\.?)", r"(?:total(?:es)?|superficie total)"
#: Communes that texts name, in the order in which they are sought.
KNOWN_COMUNAS = ("Ñuñoa", "Providencia", "Santiago", "Las Condes", "La Reina", "Macul", "Vitacura", "La Florida", "San Miguel", "Recoleta", "Independencia", "Peñalolén", "Lo Barnechea", "La Dehesa", "Maipu")
#: Words at which the attributes after an area end.
TAIL_ENDS = r"(?i)\b(?:contactar|compara|anadir|favoritos?|publicado|ver|whatsapp)\b"


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where it is empty or there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _not_after(owner: str | None, marks: str) -> str:
    """The place is not behind a feature's word that still waits for its number."""
    return rf"(?<!(?<!\d ?){owner} ?(?:{marks})? ?)" if owner else ""


def _beside(text: Column, field: str, owner: str | None, hedge: str | None = None) -> tuple[Column, Column]:
    """(number, confidence) beside a feature's word: after it, else before it; low where a hedging word is near."""
    word, number = WORDS[field], BELIEVED[field]
    after = rf"(?:\b{word} ?[:=-]|(?<!\d ?)\b{word}) ?({number})\b"
    before = rf"{_not_after(owner, 'incluidos?|incluye|[:=-]')}\b({number}) ?{word}\b"
    value = F.coalesce(_part(text, after), _part(text, before)).cast("int")
    sure = F.lit("high")
    if hedge:
        pattern = F.when(_part(text, after).isNotNull(), F.lit(after)).otherwise(F.lit(before))
        at, found = F.regexp_instr(text, pattern), F.regexp_substr(text, pattern)
        around = F.substring(text, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)) + F.length(found) + 30)
        sure = F.when(around.rlike(hedge), "low").otherwise("high")
    return value, F.when(value.isNotNull(), sure)


def rooms(raw: Column) -> Column:
    """struct of bedrooms, baths and parking with the confidence of each: compact forms first, then numbers beside words."""
    return let(match_key(raw), _rooms)


def _rooms(text: Column) -> Column:
    compact = {"dormitorios": [_part(text, COMPACT, 1)], "banos": [_part(text, COMPACT, 2), _part(text, COMPACT_BATHS, 1)], "estacionamientos": [_part(text, COMPACT, 3), _part(text, COMPACT_BATHS, 2)]}
    owners = {"dormitorios": None, "banos": WORDS["dormitorios"], "estacionamientos": f"(?:{WORDS['dormitorios']}|{WORDS['banos']})"}
    values, levels = [], []
    for field in WORDS:
        short = F.coalesce(*compact[field]).cast("int")
        value, level = _beside(text, field, owners[field], OPTIONAL if field == "estacionamientos" else None)
        if field == "estacionamientos":
            first = F.when(text.rlike(OPTIONAL_PARKING[0]), F.coalesce(_part(text, OPTIONAL_PARKING[0]).cast("int"), F.lit(1)))
            spare = F.coalesce(F.when(first <= 6, first), F.when(text.rlike(OPTIONAL_PARKING[1]), 1))
            value, level = F.coalesce(value, spare), F.coalesce(level, F.when(spare.isNotNull(), "low"))
        values.append(F.coalesce(short, value).alias(field))
        levels.append(F.when(short.isNotNull(), "medium").otherwise(level).alias(f"{field}_confidence"))
    return F.struct(*values, *levels)


def _believed_area(text: Column, pattern: str) -> Column:
    """The first match's whole run of digits, if it has two to four and says 10 to 1,000."""
    run = _part(text, pattern)
    value = F.when(F.length(run) <= 4, run.cast("int"))
    return F.when(value.between(10, 1000), value)


def area(raw: Column) -> Column:
    """struct(m2, confidence): with a unit, with a label or a bare m, or a lone number of 20 to 500 with no price near it."""
    both = F.struct(F.lower(F.coalesce(clean_text(raw), F.lit(""))).alias("low"), F.coalesce(match_key(raw), F.lit("")).alias("text"))
    return let(both, lambda t: _area(t["low"], t["text"]))


def _area(low: Column, text: Column) -> Column:
    tier = lambda patterns: F.coalesce(*[_believed_area(t, p) for p in patterns for t in (low, text)])
    gap = lambda word: 25 - len(word.replace("\\", ""))
    alone = r"(?<!\d.{0,24})" + "".join(rf"(?<!{w}.{{0,{gap(w)}}})" for w in MONEY)
    ahead = r"(?!.{0,24}\d)" + "".join(rf"(?!.{{0,{gap(w)}}}{w})" for w in MONEY)
    bare = _part(text, rf"{alone}\b(0{{0,2}}[2-9]\d|0?[1-4]\d\d|0?500)\b{ahead}").cast("int")
    sure, likely = tier(SURE), tier(LIKELY)
    return F.struct(F.coalesce(sure, likely, bare).alias("m2"), F.when(sure.isNotNull(), "high").when(likely.isNotNull(), "medium").otherwise("low").alias("confidence"))


def labelled_area(raw: Column) -> Column:
    """The best labelled area of 10 to 1,000: useful before built before no label before total, with a unit before without."""
    return let(match_key(raw), _labelled_area)


def _labelled_area(text: Column) -> Column:
    amount = r"(\d++(?:[.,]\d++)?+)"
    labels = rf"(?:{USEFUL}|{TOTAL}|{BUILT}|{PLAIN})"
    # A look back costs many steps, so it comes last of what is asked of a place.
    free = rf"(?<!\d ?{UNIT} ?)"

    def first(pattern: str) -> Column:
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))
        return F.try_element_at(F.filter(values, lambda v: v.between(10, 1000)), F.lit(1))

    found = []
    for label in (USEFUL, BUILT, PLAIN, TOTAL):
        lead = rf"(?={label} ?(?:de)? ?:? ?\d){free}{label} ?(?:de)? ?:? ?{amount}"
        found.append(first(rf"{lead} ?{UNIT}"))
        if label == PLAIN:
            found += [first(rf"(?=m)(?<!\d ?){UNIT} ?:? ?{amount}"), first(rf"{amount} ?{UNIT}(?! ?{labels})")]
        found += [first(rf"{amount} ?{UNIT} ?{label}"), first(rf"{lead}(?! ?{UNIT})")]
    return F.coalesce(*found)


def first_area(raw: Column) -> Column:
    """The number of the first area with a unit, whatever its label."""
    value = F.replace(_part(match_key(raw), rf"(\d+(?:[.,]\d+)?) ?{UNIT}"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 0, value)


#: The words of a card's rooms, longest first, and the numbers that are believed there.
CARD_WORDS = {"dormitorios": (("habitaciones", "dormitorios", "dormitorio", "habitacion", "dorms", "dorm"), "0?[1-6]"), "banos": (("banos", "bano"), "0?[1-5]")}


def nearest_number(raw: Column, field: str) -> Column:
    """A card's number of bedrooms or baths: the smallest gap to its word, then the longest word, then before it, then the first."""
    return let(match_key(raw), lambda text: _nearest(text, field))


def _nearest(text: Column, field: str) -> Column:
    words, number = CARD_WORDS[field]
    other = "|".join(CARD_WORDS["banos" if field == "dormitorios" else "dormitorios"][0])
    free = _not_after(f"(?:{other})", "[:=.-]")
    before = ("", " ", None, None)
    after = ("", "(?: |[:=.-])", "(?: [:=.-]|[:=.-] )", " [:=.-] ")
    ways = []
    for near, far in zip(before, after):
        for word in words:
            ways += [] if near is None else [rf"(?=\b{number}{near}{word}\b){free}({number}){near}{word}\b"]
            ways.append(rf"\b{word}{far}({number})\b")
    return F.coalesce(*[_part(text, way) for way in ways]).cast("int")


def number_near(raw: Column, words: tuple[str, ...], fallback: tuple[str, ...] = ()) -> Column:
    """The number that stands before or after one of the words, words in order; a zero found first is no answer."""
    return let(match_key(raw), lambda text: _near(text, words, fallback))


def _near(text: Column, words: tuple[str, ...], fallback: tuple[str, ...]) -> Column:
    found = [_part(text, p) for w in words for p in (rf"(\d+) ?{w}", rf"{w} ?(\d+)")] + [_part(text, p) for p in fallback]
    value = F.coalesce(*found).try_cast("int")
    return F.when(value > 0, value)


#: Forms of a search result's rooms.
ROOM_FORMS = {
    "dormitorios": (("dormitorios", "dormitorio", "dorm"), (r"(\d+) ?(?:d|dorm|dorms|hab|habitacion|habitaciones)\b", r"(?:dormitorios?|habitaciones?) ?:? ?(\d+)")),
    "banos": (("banos", "bano"), (r"(\d+) ?(?:b|ban|bano|banos)\b", r"(?:banos?|bathrooms?) ?:? ?(\d+)")),
    "estacionamientos": (("estacionamiento", "estacionamientos", "estac"), ()),
}


def result_rooms(raw: Column, field: str) -> Column:
    return number_near(raw, *ROOM_FORMS[field])


def tail_after_area(raw: Column) -> Column:
    """What follows the first area with a unit, up to a word that ends a card's attributes; null without such an area."""
    unit = r"(?:m\s*(?:2|²|\?)|mts?|mt2|mtrs?|metros?)"
    tail = _part(clean_text(raw), rf"(?i)\b\d+(?:[.,]\d+)?\s*{unit}(?![\p{{L}}\p{{N}}])(.*)$")
    return F.get(F.split(tail, TAIL_ENDS, 2), F.lit(0))


def card_rooms(raw: Column) -> Column:
    """struct of a card's rooms: beside their words anywhere in the text, else in the tail after its area."""
    words, fallback = ROOM_FORMS["estacionamientos"]

    def read(t: Column) -> Column:
        rooms = [F.coalesce(_nearest(t["all"], f), _nearest(t["tail"], f)).alias(f) for f in CARD_WORDS]
        return F.struct(*rooms, F.coalesce(_near(t["all"], words, fallback), _near(t["tail"], words, fallback)).alias("estacionamientos"))

    return let(F.struct(match_key(raw).alias("all"), match_key(tail_after_area(raw)).alias("tail")), read)


def comuna_in_text(text: Column, names: tuple[str, ...] = KNOWN_COMUNAS) -> Column:
    """The first of ``names`` that stands in the text, in the order given."""
    return let(match_key(text), lambda key: F.coalesce(*[F.when(F.contains(key, F.lit(plain(n))), F.lit(n)) for n in names]))


def comuna_in_location(location: Column, names: tuple[str, ...] = KNOWN_COMUNAS) -> Column:
    """The first part of a location (cut at ',' or '|') that is one of ``names``."""
    known = F.array(*[F.lit(plain(n)) for n in names])
    parts = F.filter(F.transform(F.split(location, r"[,|]"), lambda p: F.trim(p)), lambda p: F.array_contains(known, match_key(p)))
    return F.try_element_at(parts, F.lit(1))


#: Forms of a price in free text; the second of each pair says whether the amount is put after a sign of its own.
PRICES = (
    (r"(?i)(?:UF|U\.F\.|CLF)\s*([\d.,]+)", "UF"),
    (r"(?i)([\d.,]+)\s*(?:UF|U\.F\.|CLF)\b", "UF"),
    (r"(\$\s*[\d.,]+)", "$"),
    (r"(?i)(?:CLP|CH\$)\s*([\d.,]+)", "$"),
    (r"(?i)([\d.,]+)\s*(?:pesos|clp)\b", "$"),
)


def price_in_text(text: Column) -> Column:
    """The first price of free text as it stands where it holds 'UF' or '$', else its amount after that sign."""
    found = []
    for pattern, sign in PRICES:
        whole, amount = F.nullif(clean_text(F.regexp_substr(text, F.lit(pattern))), F.lit("")), _part(text, pattern)
        found.append(F.when(amount.isNotNull(), F.when(F.contains(F.upper(whole), F.lit(sign)), whole).otherwise(F.concat(F.lit(f"{sign} "), amount))))
    return F.coalesce(*found)


def price_amounts(price: Column) -> tuple[Column, Column]:
    """(CLP, UF) of a price that price_in_text() gave: 'uf' makes it UF, '$' whole pesos."""
    uf = F.contains(F.lower(price), F.lit("uf"))
    digits = F.nullif(F.regexp_replace(price, r"[^0-9]", ""), F.lit("")).try_cast("bigint")
    return F.when(~uf & F.contains(price, F.lit("$")), digits), F.when(uf, locale_number(price))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of the parts stands in the text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
