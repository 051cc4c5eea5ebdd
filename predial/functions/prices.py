"""Prices, rates, price per m2 and size classes as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def _positive(value: Column) -> Column:
    return F.when(value > 0, value.cast("double"))


def ask_clp(cfg: Config = DEFAULT, rate: Column | None = None) -> Column:
    """Asking price in CLP: UF times the live rate (or the fixed one) first, else CLP; only positive prices count."""
    rate = F.lit(cfg.uf_to_clp) if rate is None else F.coalesce(rate, F.lit(cfg.uf_to_clp))
    return F.coalesce(_positive(F.col("precio_uf")) * rate, _positive(F.col("precio_clp")))


def ask_uf(cfg: Config = DEFAULT) -> Column:
    return F.coalesce(_positive(F.col("precio_uf")), _positive(F.col("precio_clp")) / F.lit(cfg.uf_to_clp))


def quality_clp(cfg: Config = DEFAULT) -> Column:
    """The price that data quality looks at: CLP first, else UF at the quality rate."""
    return F.coalesce(_positive(F.col("precio_clp")), _positive(F.col("precio_uf")) * F.lit(cfg.quality_uf_to_clp))


def historical_clp(columns: list[str], cfg: Config = DEFAULT) -> Column:
    """The first positive of new CLP, CLP, new UF and UF of a price log's row, as far as it has these columns."""
    rates = (("precio_clp_nuevo", 1.0), ("precio_clp", 1.0), ("precio_uf_nuevo", cfg.uf_to_clp), ("precio_uf", cfg.uf_to_clp))
    return F.coalesce(*[_positive(F.col(c)) * F.lit(rate) for c, rate in rates if c in columns])


def uf_rate(live: Column, cached: Column, cfg: Config = DEFAULT) -> Column:
    """The live rate if it is positive, else the cached one, else the fixed one."""
    return F.coalesce(_positive(live), _positive(cached), F.lit(cfg.uf_to_clp))


def fill_currencies(cfg: Config = DEFAULT, text: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Each missing currency from the other one, both from (CLP, UF) of a text where neither is known; CLP is cut to a whole number."""
    clp, uf = _positive(F.col("precio_clp")), _positive(F.col("precio_uf"))
    if text is not None:
        none = clp.isNull() & uf.isNull()
        clp, uf = F.when(none, text[0]).otherwise(clp), F.when(none, text[1]).otherwise(uf)
    return {"precio_clp": F.coalesce(clp, uf * F.lit(cfg.uf_to_clp)).cast("bigint"), "precio_uf": F.coalesce(uf, clp / F.lit(cfg.uf_to_clp))}


def segment(m2: Column) -> Column:
    """Market segment; an unknown area counts as standard."""
    return F.when(m2.isNull(), "standard_apartment").when(m2 < 50, "small_apartment").when(m2 <= 100, "standard_apartment").otherwise("large_apartment")


def adjacent(a: Column, b: Column) -> Column:
    """Whether two segments are the same or next to each other: all but small with large."""
    return (a == b) | (a == "standard_apartment") | (b == "standard_apartment")


def size_bucket(m2: Column) -> Column:
    return F.when(m2.isNull(), "sin_dato").when(m2 < 60, "pequeno").when(m2 <= 100, "mediano").otherwise("grande")


def benchmark_range(m2: Column) -> Column:
    return F.when(m2.isNull(), "sin_dato").when(m2 < 50, "<50").when(m2 <= 100, "50-100").otherwise(">100")


def sane_m2(m2: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce(m2.between(cfg.min_m2, cfg.max_m2), F.lit(False))


def sane_price_m2(clp_m2: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce((clp_m2 > 0) & (clp_m2 / F.lit(cfg.uf_to_clp)).between(cfg.min_uf_m2, cfg.max_uf_m2), F.lit(False))


def short_price(value: Column) -> Column:
    """'N/D', millions as '95M', or whole pesos with dots."""
    return F.when(value.isNull(), "N/D").when(value >= 1_000_000, F.concat(F.bround(value / 1e6).cast("bigint").cast("string"), F.lit("M"))).otherwise(F.translate(F.format_number(F.bround(value), 0), ",", "."))


def full_price(value: Column) -> Column:
    """'Sin precio', or whole pesos with dots as '$95.000.000'."""
    return F.when(value.isNull(), "Sin precio").otherwise(F.concat(F.lit("$"), F.translate(F.format_number(F.bround(value), 0), ",", ".")))


def heuristic_price(base: Column, m2: Column, land: Column, extras: Column, age: Column) -> Column:
    """Location base plus built area, land and extras, less age."""
    return base + F.coalesce(m2, F.lit(0)) * 650_000 + F.coalesce(land, F.lit(0)) * 120_000 + F.coalesce(extras, F.lit(0)) - F.coalesce(age, F.lit(0)) * 500_000
