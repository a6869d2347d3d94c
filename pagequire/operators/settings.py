"""Settings tables: defaults, migration of old profiles, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults by key.
DEFAULTS = {
    "mode": "manga", "crop_mode": "strict", "detector": "auto", "nav_transition_mode": "classic",
    "panel_margin_ratio": 0.12, "panel_bleed_ratio": 0.08, "panel_bleed_min": 8.0, "panel_prefetch_delay": 0.75,
    "nav_transition_duration": 0.4, "nav_transition_frames": 8.0, "full_page_panel_ratio": 0.92, "segment_gutter_ratio": 0.005,
    "panel_grid_cols": 4, "panel_grid_rows": 7, "panel_cache_pages": 12, "segment_target_width": 480, "debug_mode": False,
}
#: Keys that profiles before the current one get anew, and those that are held to the default from one side.
RESET = ("panel_grid_rows", "panel_grid_cols", "panel_cache_pages", "full_page_panel_ratio", "segment_target_width", "segment_gutter_ratio")
CURRENT = 7


def first_of(current: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Settings rows of the current store, and those of the legacy one for keys that the current one lacks."""
    return current.unionByName(legacy.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def apply_defaults(settings: DataFrame) -> DataFrame:
    """Nulls and absent keys become defaults, old names new ones, and profiles before the current version are reset or held to today's limits.

    Keys that have no default here stay as they are.
    """
    has = lambda k: F.col(k) if k in settings.columns else F.lit(None)
    version = F.coalesce(has("performance_profile_version"), F.lit(0)).cast("int")
    old = version < CURRENT

    def value(key: str) -> Column:
        d = F.lit(DEFAULTS[key])
        given = has(key)
        if key == "debug_mode":
            given = F.coalesce(given, has("debug_timing"))
        if key == "detector":
            given = F.when(given == "native", "exact").otherwise(given)
        v = F.coalesce(given, d)
        if key in RESET:
            return F.when(old, d).otherwise(v)
        if key == "panel_bleed_ratio":
            return F.when(old, F.least(v, F.lit(1.0))).otherwise(v)
        if key == "panel_bleed_min":
            return F.when(old, F.least(v, d)).otherwise(v)
        if key == "panel_prefetch_delay":
            return F.when(old, F.greatest(v, d)).otherwise(v)
        return v

    rest = [c for c in settings.columns if c not in DEFAULTS and c not in ("debug_timing", "performance_profile_version")]
    return settings.select(*rest, *[value(k).alias(k) for k in DEFAULTS], F.greatest(version, F.lit(CURRENT)).alias("performance_profile_version"))


def clamp_settings(settings: DataFrame) -> DataFrame:
    """Numbers within their limits, unknown modes the default; a comic has no exact detector."""
    within = lambda k, low, high: F.least(F.greatest(F.col(k), F.lit(low)), F.lit(high))
    known = lambda k, *names: F.when(F.col(k).isin(*names), F.col(k)).otherwise(DEFAULTS[k])
    detector = known("detector", "fast", "exact")
    return settings.withColumns(
        {
            "panel_margin_ratio": within("panel_margin_ratio", 0.0, 0.4),
            "panel_bleed_ratio": within("panel_bleed_ratio", 0.0, 1.0),
            "nav_transition_duration": within("nav_transition_duration", 0.15, 0.9),
            "nav_transition_frames": F.least(F.greatest(F.floor(F.col("nav_transition_frames") + 0.5), F.lit(1)), F.lit(24)).cast("int"),
            "mode": known("mode", "comic"),
            "crop_mode": known("crop_mode", "loose", "margin", "none"),
            "nav_transition_mode": known("nav_transition_mode", "smooth"),
            "detector": F.when((detector == "exact") & (F.col("mode") == "comic"), "auto").otherwise(detector),
        }
    )
