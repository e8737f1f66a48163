"""Player engagement features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import ordinal, ratio
from cohortry.operators.ranking import sample_n
from cohortry.plans.presets import ENGAGEMENT_LEVELS


def player_features(df: DataFrame, encode_target: bool = True) -> DataFrame:
    """Ratios and products of the player columns, and the target as 0, 1, 2."""
    out = df.withColumns({
        "Global_Duration": ratio("PlayTimeHours", "SessionsPerWeek"),
        "AchievementsUnlocked_hr": ratio("AchievementsUnlocked", "PlayTimeHours"),
        "Purchasers_Age": F.col("Age") * F.col("InGamePurchases"),
        "PlayerLevel_Age": ratio("PlayerLevel", "Age"),
        "PlayerLevel_PlayTimeHours": ratio("PlayerLevel", "PlayTimeHours"),
    })
    if encode_target:
        out = out.withColumn("EngagementLevel", ordinal("EngagementLevel", ENGAGEMENT_LEVELS))
    return out


def prepare(df: DataFrame, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Optional exact sample, then the features."""
    return player_features(df if sample_size is None else sample_n(df, sample_size, "PlayerID", seed))
