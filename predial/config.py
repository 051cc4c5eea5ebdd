"""Constants of the listings model, as one immutable record."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Thresholds and rates. The values are fixed by the domain; a caller may replace any of them."""

    uf_to_clp: float = 37_000.0
    quality_uf_to_clp: float = 38_000.0
    min_m2: float = 10.0
    max_m2: float = 1_000.0
    quality_min_m2: float = 20.0
    quality_max_m2: float = 500.0
    min_uf_m2: float = 5.0
    max_uf_m2: float = 300.0
    min_clp_m2: float = 500_000.0
    max_clp_m2: float = 10_000_000.0
    m2_range: float = 0.15
    similar_m2: float = 0.30
    max_candidates: int = 150
    top_k: int = 10
    min_score: float = 0.40
    relaxed_score: float = 0.25
    low_data_score: float = 0.55
    radar_min_comparables: int = 3
    low_data_radar_comparables: int = 5
    segment_comparables: int = 5
    valuation_comparables: int = 5
    low_data_valuation_comparables: int = 6
    min_undervaluation: float = 0.05
    low_data_undervaluation: float = 0.10
    outlier_discount: float = 0.30
    min_market_confidence: float = 0.25
    radar_dataset: int = 10
    low_data_active: int = 50
    low_data_comuna: int = 10
    dorm_fallback: float = 0.90
    comuna_penalty: float = 0.15
    segment_penalty: float = 0.10
    adjacent_cluster: float = 0.90
    far_cluster: float = 0.75
    min_weight: float = 0.02
    full_weights: int = 5
    weight_power: float = 1.2
    full_score_km: float = 0.5
    no_score_km: float = 10.0
    earth_km: float = 6371.0
    duplicate_m2: float = 0.10
    m2_step: int = 5
    expiry_days: int = 7


DEFAULT = Config()
