"""Feature dictionaries: profiles, aliases, named recipes and window-table typing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ENTITY_STATS, FEATURE_CATEGORY, MAX_RECIPE_INPUTS, WINDOW_FEATURES


def base_features(profile: str = "all20") -> list[str]:
    """All window features, or those left after dropping the signal-quality category."""
    key = profile.strip().lower().replace("-", "_")
    if key in ("all20", "all", "full"):
        return list(WINDOW_FEATURES)
    if key in ("physiology_only", "physiology"):
        return [f for f in WINDOW_FEATURES if f not in FEATURE_CATEGORY["SIGNAL_QUALITY"]]
    raise ValueError("profile must be all20 or physiology_only")


def profile_columns(profile: str = "all20", stats: list[str] = ENTITY_STATS) -> list[str]:
    return [f"{f}_{s}" for f in base_features(profile) for s in stats]


def select_profile(df: DataFrame, ids: list[str], bases: list[str], stats: list[str] = ENTITY_STATS) -> DataFrame:
    """Id columns and the statistics of the chosen base features."""
    wanted = [f"{b}_{s}" for b in bases for s in stats]
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    return df.select(*ids, *wanted)


def canonical_name(name: str) -> str | None:
    """Feature name from `feature_07`, the name itself, or the name with a statistic suffix."""
    text = name.strip()
    if text in WINDOW_FEATURES:
        return text
    if text.startswith("feature_") and text[8:].isdigit() and 1 <= int(text[8:]) <= len(WINDOW_FEATURES):
        return WINDOW_FEATURES[int(text[8:]) - 1]
    for stat in ENTITY_STATS:
        if text.endswith(f"_{stat}") and text[: -len(stat) - 1] in WINDOW_FEATURES:
            return text[: -len(stat) - 1]
    return None


def rename_aliases(df: DataFrame) -> DataFrame:
    """Columns `feature_NN` and `feature_NN_valid` under their feature names."""
    renamed = {}
    for number, name in enumerate(WINDOW_FEATURES, start=1):
        for source, target in ((f"feature_{number:02d}", name), (f"feature_{number:02d}_valid", f"{name}_valid")):
            if source in df.columns and target not in df.columns:
                renamed[source] = target
    return df.withColumnsRenamed(renamed)


def spread_features(df: DataFrame, ids: list[str], bases: list[str]) -> DataFrame:
    """Median and p90-p10 spread of each base feature."""
    cols = []
    for b in bases:
        cols.append(F.col(f"{b}_p50").alias(f"{b}_median"))
        cols.append((F.col(f"{b}_p90") - F.col(f"{b}_p10")).alias(f"{b}_p90_p10"))
    return df.select(*ids, *cols)


def drop_redundant(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def additions(base: list[str], candidates: list[str]) -> dict[str, list[str]]:
    """One recipe per candidate: the base and that candidate."""
    return {f"SINGLE_{c.upper()}": [*base, c] for c in sorted(candidates)}


def pair_swaps(base: list[str], dropped: str, anchor: str, candidates: list[str]) -> dict[str, list[str]]:
    """Recipes that trade one base input for the anchor and one more candidate."""
    kept = [c for c in base if c != dropped]
    return {f"PAIR_{c.upper()}": [*kept, anchor, c] for c in sorted(candidates) if c != anchor}


def check_recipes(recipes: dict[str, list[str]], columns: list[str], cap: int = MAX_RECIPE_INPUTS) -> dict[str, list[str]]:
    """Recipes unchanged; raises on repeated, missing or too many inputs."""
    for name, cols in recipes.items():
        if len(cols) != len(set(cols)):
            raise ValueError(f"{name} repeats an input")
        if len(cols) > cap:
            raise ValueError(f"{name} has {len(cols)} inputs, at most {cap} allowed")
        absent = sorted(set(cols) - set(columns))
        if absent:
            raise ValueError(f"{name} uses unknown inputs {absent}")
    return recipes


def coerce_window_types(df: DataFrame, features: list[str], flags: list[str], keys: list[str]) -> DataFrame:
    """Features as finite-or-null doubles, flags non-null, missing validity bits derived, rows in key order."""
    from ..functions.parsing import nan_to_null

    typed = {f: nan_to_null(F.col(f).cast("double")) for f in features}
    bits = {}
    for f in features:
        bit = f"{f}_valid"
        bits[bit] = F.coalesce(F.col(bit), F.lit(False)) if bit in df.columns else typed[f].isNotNull()
    known = {f: F.coalesce(F.col(f), F.lit(False)) if f in df.columns else F.lit(False) for f in flags}
    return df.withColumns({**bits, **known}).withColumns(typed).orderBy(*keys)
