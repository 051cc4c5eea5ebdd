"""Distances, centroids and micro-locations."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .text import let, match_key, plain, strip_accents

#: Centroids of communes by their key, for filling in coordinates.
CENTROIDS = {
    "nunoa": (-33.4543, -70.5936),
    "providencia": (-33.4263, -70.6170),
    "las condes": (-33.4080, -70.5670),
    "vitacura": (-33.3850, -70.5650),
    "santiago": (-33.4489, -70.6693),
    "macul": (-33.4870, -70.5990),
}
#: Coarser centroids of communes by their name, for showing a commune on a map.
NAMED_CENTROIDS = {
    "Ñuñoa": (-33.456, -70.597), "Providencia": (-33.426, -70.617), "Las Condes": (-33.408, -70.567), "Santiago": (-33.448, -70.669), "Vitacura": (-33.386, -70.573), "La Reina": (-33.441, -70.535), "Macul": (-33.487, -70.599),
    "La Florida": (-33.522, -70.598), "San Miguel": (-33.496, -70.651), "Recoleta": (-33.406, -70.642), "Independencia": (-33.414, -70.665), "Peñalolén": (-33.486, -70.533), "Puente Alto": (-33.616, -70.575),
}
#: Places that titles name.
PLACES = {
    "metro nuble": (-33.456, -70.613),
    "nuble": (-33.456, -70.613),
    "metro ñuble": (-33.456, -70.613),
    "plaza egana": (-33.454, -70.575),
    "egana": (-33.454, -70.575),
    "irarrazaval": (-33.455, -70.625),
    "irarrázaval": (-33.455, -70.625),
    "san eugenio": (-33.459, -70.620),
    "zanartu": (-33.460, -70.615),
    "los leones": (-33.420, -70.610),
}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cfg: Config = DEFAULT) -> Column:
    """Great-circle distance; null where a coordinate is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * cfg.earth_km)


def distance_score(km: Column, cfg: Config = DEFAULT) -> Column:
    """1 near, 0 far, linear between."""
    line = 1 - (km - cfg.full_score_km) / (cfg.no_score_km - cfg.full_score_km)
    return F.when(km <= cfg.full_score_km, 1.0).when(km >= cfg.no_score_km, 0.0).otherwise(line)


def distance_penalty(km: Column, scale: float = 2.0, hard: float = 5.0) -> Column:
    """Exponential decay, halved beyond the hard cap; 1 where the distance is unknown."""
    return F.when(km.isNull(), 1.0).otherwise(F.exp(-km / scale) * F.when(km > hard, 0.5).otherwise(1.0))


def place_in_title(title: Column, places: dict[str, tuple[float, float]] = PLACES) -> Column:
    """The longest place key of which some word stands in the title (the first of equally long ones), else null."""
    some = lambda text, p: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in plain(p).split()])
    by_length = sorted(places, key=lambda p: -len(plain(p)))
    return let(strip_accents(F.lower(title)), lambda text: F.coalesce(*[F.when(some(text, p), F.lit(p)) for p in by_length]))


def _position(lat: float, lon: float) -> Column:
    return F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))


def place_position(title: Column, places: dict[str, tuple[float, float]] = PLACES) -> Column:
    """struct(lat, lon) of place_in_title(), else null."""
    return let(place_in_title(title, places), lambda place: F.coalesce(*[F.when(place == p, _position(*at)) for p, at in places.items()]))


def centroid(comuna: Column, places: dict[str, tuple[float, float]] = CENTROIDS) -> Column:
    """struct(lat, lon) of a commune by its key, else null."""
    return let(match_key(comuna), lambda key: F.coalesce(*[F.when(key == name, _position(*at)) for name, at in places.items()]))


def named_centroid(comuna: Column) -> Column:
    """struct(lat, lon) of a commune by its exact name, else null."""
    return F.coalesce(*[F.when(comuna == name, _position(*at)) for name, at in NAMED_CENTROIDS.items()])
