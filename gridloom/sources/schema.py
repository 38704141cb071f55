"""The cell table's schema, the feature manifest, provenance and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Feature, source, time window, allowed for training.
MANIFEST = [
    ("tree_cover_2000_pct", "Hansen/UMD GFW v1.7", "2000 (static)", True),
    ("elevation_m", "SRTM 30m", "static", True),
    ("slope_deg", "SRTM 30m", "static", True),
    ("dist_to_road_km", "OpenStreetMap Overpass", "snapshot", True),
    ("dist_to_deforestation_frontier_km", "Hansen GFW (pre-2020 loss)", "2001-2019", True),
    ("protected_area", "OpenStreetMap", "snapshot", True),
    ("population_density_per_km2", "WorldPop API", "2019 estimate", True),
    ("annual_loss_rate_pct", "Hansen GFW (pre-2020 loss)", "2001-2019", True),
    ("exg_change_2018_2019", "Sentinel-2 cloudless (EOX)", "2018-2019", True),
    ("neighbor_loss_count", "Derived (pre-2020 loss)", "2001-2019", True),
    ("neighbor_loss_density", "Derived (pre-2020 loss)", "2001-2019", True),
    ("neighbor_mean_tree_cover", "Derived (2000 tree cover)", "2000 (static)", True),
    ("loss_acceleration", "Derived (pre-2020 loss rate)", "2001-2019", True),
    ("fire_hotspot_density", "Derived: high-loss-rate neighbor count (pre-2020)", "2001-2019", True),
    ("exg_change_2018_2022", "Sentinel-2 cloudless (EOX)", "2018-2022", False),
    ("loss_year", "Hansen GFW", "2001-2022", False),
    ("high_risk", "Target variable", "2020-2022", False),
    ("pre_period_loss", "Derived from loss_year", "2001-2019", False),
]
# Region, lat_min, lat_max, lon_min, lon_max, step.
REGIONS = [
    ("palawan", 8.5, 12.3, 117.2, 120.3, 0.02),
    ("sierra_madre", 15.5, 17.5, 121.0, 122.5, 0.02),
    ("mindanao_bukidnon", 7.5, 8.8, 124.5, 125.5, 0.02),
]

ALLOWED = [name for name, _, _, allowed in MANIFEST if allowed]
CELLS = T.StructType(
    [T.StructField("region", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
    + [T.StructField(n, T.IntegerType() if n == "protected_area" else T.DoubleType()) for n in ALLOWED[:9]]
    + [T.StructField(n, T.IntegerType()) for n in ("pre_period_loss", "high_risk", "loss_year")]
)


def available_features(df: DataFrame) -> list[str]:
    """Allowed features that ``df`` has, in manifest order."""
    return [name for name in ALLOWED if name in df.columns]


def project_features(df: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the allowed features that ``df`` has, in manifest order."""
    return df.select(*keys, *available_features(df))


def check_features(names: list[str]) -> list[str]:
    """Refuse features whose window overlaps the target's; unknown names pass, as the caller may bring their own."""
    banned = [n for n, _, _, allowed in MANIFEST if not allowed and n in names]
    if banned:
        raise ValueError(f"not allowed for training: {', '.join(banned)}")
    return names


def manifest(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(MANIFEST)]
    return spark.createDataFrame(rows, "place long, feature string, source string, time_window string, allowed boolean")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, lat_min double, lat_max double, lon_min double, lon_max double, step double")
