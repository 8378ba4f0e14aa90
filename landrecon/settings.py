"""Thresholds, weights and enumerations shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# Source types, the canonical feature type of each, and role names.
CANONICAL_TYPE = {
    "cadastral": "parcel",
    "land_use": "parcel",
    "revenue": "parcel",
    "municipal": "building",
    "gnss": "gnss_point",
    "ground_truth": "ground_truth",
    "utility": "utility",
    "drone": "building",
    "orthoimagery": "raster",
    "dsm": "raster",
    "dtm": "raster",
}
DEFAULT_CANONICAL_TYPE = "parcel"
OWNER_ROLES = ("revenue_officer", "reviewer", "administrator")
PERSONAL_KEYS = ("owner", "owner_name", "landholder", "property_owner")
CONFLICT_STATUSES = ("Open", "Under Review", "Resolved", "Accepted", "Rejected")
TERMINAL_STATUSES = ("Resolved", "Accepted", "Rejected")
CONFLICT_TYPES = (
    "parcel_overlap", "building_boundary_crossing", "utility_crossing", "area_mismatch",
    "duplicate_id", "gnss_outside_parcel", "owner_mismatch",
)

# Canonical fields in priority order, each with its known synonyms.
CANONICAL_SYNONYMS = {
    "parcel_id": ["parcel_id", "survey_no", "survey_number", "plot_no", "plot_number",
                  "property_id", "khasra_no", "khasra_number", "gat_no", "parcel_no"],
    "owner_name": ["owner", "owner_name", "landholder", "property_owner", "holder_name",
                   "pattadar_name", "khatedar"],
    "area": ["area", "area_sq_m", "area_sqm", "plot_area", "land_area", "extent",
             "area_sq_ft", "parcel_area"],
    "land_use": ["land_use", "landuse", "usage_type", "zone_type", "property_type",
                 "classification", "land_type"],
    "survey_number": ["survey_number", "survey_no", "sy_no", "s_no", "khasra_no"],
    "building_count": ["building_count", "num_buildings", "structure_count", "bldg_count"],
    "ward": ["ward", "ward_no", "ward_number", "zone", "block"],
    "address": ["address", "location", "locality", "street_address"],
    "status": ["status", "record_status", "mutation_status"],
}
NUMERIC_CANONICAL = ("area", "building_count")

# Fields compared when matching, and the ones that are identifiers.
COMPARED_FIELDS = ("owner_name", "land_use", "parcel_id", "survey_number", "address")
IDENTIFIER_FIELDS = ("parcel_id", "survey_number")
DUPLICATE_KEY_FIELDS = ("parcel_id", "survey_no", "property_id", "khasra_no", "plot_no")
VERSION_KEY_FIELDS = ("property_id", "parcel_id", "survey_number", "survey_no", "gat_no",
                      "asset_id", "point_id")

# The stages a completed run reports, in order.
PIPELINE_STAGES = (
    "Ingestion", "CRS Normalization", "Schema Mapping", "Topology Validation",
    "Spatial Matching", "Conflict Detection", "Conflict Resolution",
    "Confidence Scoring", "Unified Land Record", "Change Detection",
)

# Name phrases and field cues used to suggest a source type.
SOURCE_NAME_PHRASES = {
    "cadastral": ("cadastral", "parcel boundary", "survey map", "gat map", "cts map"),
    "revenue": ("revenue", "7/12", "712", "khata", "land record", "ownership"),
    "municipal": ("municipal", "building footprint", "property tax", "municipality"),
    "gnss": ("gnss", "cors", "gps survey", "survey point"),
    "ground_truth": ("ground truth", "ground_truth", "field verification", "field survey"),
    "utility": ("utility", "sewer", "water pipeline", "electric network", "drainage"),
    "drone": ("drone", "uav", "aerial image", "orthomosaic"),
    "orthoimagery": ("orthoimagery", "ortho imagery", "ori", "orthophoto"),
    "dsm": ("dsm", "surface model", "digital surface"),
    "dtm": ("dtm", "terrain model", "digital terrain"),
}
SOURCE_FIELD_CUES = {
    "cadastral": ("parcel_id", "survey_number", "survey_no", "gat_no", "cts_no", "khasra_no"),
    "revenue": ("owner_name", "khata_number", "landholder", "pattadar_name", "survey_gat_no"),
    "municipal": ("building_id", "property_tax_id", "building_use", "floor_count"),
    "gnss": ("horizontal_accuracy", "horizontal_accuracy_m", "gnss_id", "fix_quality"),
    "ground_truth": ("verified", "verification_date", "field_observation", "ground_truth"),
    "utility": ("pipe_diameter", "asset_type", "network_type", "utility_id"),
}

# Field names that count as a parcel key or as accuracy evidence.
PARCEL_KEY_FIELDS = ("cts_no", "gat_no", "parcel_id", "plot_no", "survey_gat_no", "survey_no",
                     "survey_number")
ACCURACY_FIELDS = ("accuracy", "accuracy_m", "horizontal_accuracy", "horizontal_accuracy_m")


@dataclass(frozen=True)
class Settings:
    """All tunable numbers. Percent scores are on 0..100, ratios on 0..1."""

    target_epsg: int = 4326
    match_distance_m: float = 75.0
    prefilter_factor: float = 3.0
    metres_per_degree: float = 111320.0
    min_cosine: float = 0.05
    weight_proximity: float = 0.30
    weight_overlap: float = 0.30
    weight_area: float = 0.20
    weight_attribute: float = 0.20
    min_match_confidence: float = 40.0
    band_high: float = 90.0
    band_medium: float = 70.0
    mapping_review: float = 0.55
    mapping_floor: float = 0.25
    duplicate_iou: float = 0.97
    overlap_iou: float = 0.05
    overlap_major_iou: float = 0.30
    sliver_compactness: float = 200.0
    crossing_min_iou: float = 0.02
    crossing_max_iou: float = 0.85
    crossing_minor_iou: float = 0.50
    area_mismatch: float = 0.15
    area_mismatch_major: float = 0.30
    gnss_outside: float = 0.30
    decay_m: float = 50.0
    owner_similarity: float = 0.60
    area_change: float = 0.05
    fuzzy_weight: float = 0.65
    embedding_weight: float = 0.35
    footprint_iou: float = 0.82
    max_datasets: int = 20
    max_features: int = 1000
    max_vertices: int = 25000
    # How geometry is measured: "utm" (default) or "local_plane" (equirectangular metres).
    metric: str = "utm"
    # Every polygon is an axis-aligned rectangle, so overlap has a closed form in "local_plane".
    rectangles_only: bool = False
    # "ratcliff" compares texts by their matching blocks, "equality" scores 1 or 0.
    text_ratio: str = "ratcliff"
    # Grid cell edge in degrees (about 450 m), and what counts as an oversize feature.
    cell_deg: float = 0.004
    same_layer_cell_deg: float = 0.002
    oversize_cells: int = 4096
    # Cells, classes and keys with at least this many rows are split over several tasks.
    hot_rows: int = 50_000

    @property
    def search_m(self) -> float:
        return self.match_distance_m * self.prefilter_factor


DEFAULTS = Settings()
