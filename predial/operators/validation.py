"""Which scraped rows are listings: links, titles and whole rows with the reasons against them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import any_of
from ..functions.text import clean_text, match_key

#: Parts of links that lead to no listing.
NAVIGATION = ("login", "registration", "publicar", "ayuda", "seguridad", "favoritos", "notificaciones", "jms", "search?")
#: Paths of categories.
CATEGORIES = ("venta", "arriendo", "venta/departamento", "venta/casa", "venta/departamento/metropolitana")
#: Titles of cards that are none.
CARD_TITLES = ("venta", "arriendo", "arriendo de temporada", "proyectos nuevos", "departamentos", "casas", "contactar ahora", "anadir a favoritos", "compara este anuncio")
#: Titles of login pages, parts of their links, and words of properties.
PORTAL_TITLES = ("soy nuevo", "ya tengo cuenta", "ingresar", "crear cuenta", "iniciar sesion")
PORTAL_LINKS = ("login", "registration", "mercadolibre.com/jms")
PROPERTY_WORDS = ("uf", "$", "m2", "metro", "dorm", "bano", "departamento", "casa", "propiedad")


def _url(url: Column, part: int) -> Column:
    """Scheme (1), host (2) or path (3) of a url."""
    return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#;]*)", part)


def listing_link(source: Column, url: Column) -> Column:
    """Whether a link leads to a listing of the source; other sources need a scheme and a host."""
    low, path = F.lower(url), F.lower(_url(url, 3))
    first = F.contains(_url(url, 2), F.lit("yapo.cl")) & F.contains(path, F.lit("bienes-raices")) & path.rlike(r"/\d{5,}$")
    second = F.contains(low, F.lit("portalinmobiliario.com")) | path.rlike(r"/mlc[-_]?\d+") | F.contains(path, F.lit("/propiedades/"))
    other = (_url(url, 1) != "") & (_url(url, 2) != "")
    return F.when(source == "yapo", first).when(source == "portalinmobiliario", second).otherwise(other)


def navigation_link(source: Column, url: Column) -> Column:
    """Whether a link leads to navigation, a search or a category."""
    url = F.coalesce(url, F.lit(""))
    path = F.lower(F.regexp_replace(_url(url, 3), "^/+|/+$", ""))
    category = F.when(source == "yapo", (path != "") & ~F.concat(F.lit("/"), path).rlike(r"/\d{5,}$")).when(source == "portalinmobiliario", path.isin(*CATEGORIES)).otherwise(False)
    return any_of(F.lower(url), NAVIGATION) | category


def reasons(df: DataFrame) -> Column:
    """Why a scraped row is no listing: link, price, commune, area, navigation; empty for a valid row."""
    link = clean_text(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "link") if c in df.columns]))
    source = F.lower(F.trim("fuente"))
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    area = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in ("m2_construidos", "m2") if c in df.columns])
    return F.array_compact(F.array(
        F.when(link.isNull(), "missing link/url").when(~listing_link(source, link), "not a real property listing link"),
        F.when(~(positive("precio_clp") | positive("precio_uf")), "missing or invalid price"),
        F.when(clean_text(F.col("comuna")).isNull(), "missing comuna"),
        F.when(~F.coalesce(area > 0, F.lit(False)), "missing usable surface area"),
        F.when(navigation_link(source, link), "navigation/search/category link")))


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with validation_errors)."""
    marked = df.withColumn("validation_errors", reasons(df))
    return marked.where(F.size("validation_errors") == 0).drop("validation_errors"), marked.where(F.size("validation_errors") > 0)


def card_title(title: Column) -> Column:
    """Whether a card's title can be a listing's: ten characters or more and none of the usual buttons."""
    return F.coalesce((F.length(title) >= 10) & ~match_key(title).isin(*CARD_TITLES), F.lit(False))


def portal_row(df: DataFrame) -> Column:
    """Whether a portal's row is a listing: link, price, area, title and a property's words."""
    url, title = clean_text(F.col("url")), clean_text(F.col("titulo"))
    text = match_key(F.concat_ws(" ", *[clean_text(F.col(c).cast("string")) for c in ("titulo", "precio_texto", "url", "comuna", "m2", "m2_construidos") if c in df.columns]))
    fine = url.isNotNull() & ~any_of(F.lower(url), PORTAL_LINKS) & (F.col("precio_clp").isNotNull() | F.col("precio_uf").isNotNull()) & (F.col("m2_construidos") > 0)
    return F.coalesce(fine & title.isNotNull() & ~match_key(title).isin(*PORTAL_TITLES) & any_of(text, PROPERTY_WORDS), F.lit(False))
