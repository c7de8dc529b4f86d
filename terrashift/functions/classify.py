"""Threshold ladders and keyword classifiers. Thresholds, words and labels are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least dNBR of each burn severity.
BURN_SEVERITY = [(0.66, "high_severity"), (0.44, "moderate_high_severity"), (0.27, "moderate_low_severity"), (0.1, "low_severity")]

# Stages of a permit in the order in which they are tried, with the words that tell them.
PERMIT_STAGES = [
    ("cleared_lot", ["demolition", "demo", "tear down"]),
    ("foundation_framing", ["foundation", "footing", "slab"]),
    ("structure_substantial", ["framing", "structural", "rough"]),
    ("rebuild_complete", ["certificate of occupancy", "coo", "final", "c of o"]),
    ("rebuild_start", ["new dwelling", "new sfr", "new single", "new residence", "rebuild"]),
]

# Confidence of a permit's stage; any other is low.
STAGE_CONFIDENCE = [
    ("high", ["rebuild_complete", "structure_substantial"]),
    ("medium", ["foundation_framing", "cleared_lot"]),
    ("low", ["rebuild_start"]),
]

# The stages that may follow a stage.
VALID_TRANSITIONS = [
    ("destroyed", ["cleared_lot", "foundation_framing"]),
    ("cleared_lot", ["cleared_lot", "foundation_framing"]),
    ("foundation_framing", ["foundation_framing", "structure_substantial"]),
    ("structure_substantial", ["structure_substantial", "rebuild_complete"]),
    ("rebuild_complete", ["rebuild_complete"]),
]


def burn_severity(dnbr: Column) -> Column:
    """A null difference counts as unburned."""
    (low, name), *rest = BURN_SEVERITY
    out = F.when(dnbr >= low, name)
    for low, name in rest:
        out = out.when(dnbr >= low, name)
    return out.otherwise("unburned")


def sar_change(db: Column) -> Column:
    """Only null reaches unknown."""
    return F.when(db > -2.0, "minimal_change").when(db.between(-4.0, -2.0), "moderate_loss").when(db < -4.0, "severe_loss").otherwise("unknown")


def pixel_confidence(n: Column) -> Column:
    return F.when(n >= 6, "high").when(n >= 4, "medium").otherwise("low")


def permit_stage(description: Column) -> Column:
    """First stage one of whose words is in the lower-case description; null is unknown."""
    low, out = F.lower(description), F.when(description.isNull(), "unknown")
    for stage, words in PERMIT_STAGES:
        out = out.when(low.rlike("|".join(words)), stage)
    return out.otherwise("other")


def stage_confidence(stage: Column) -> Column:
    out = F.when(stage.isNull(), "low")
    for level, stages in STAGE_CONFIDENCE:
        out = out.when(stage.isin(stages), level)
    return out.otherwise("low")


def recovery_status(months: Column) -> Column:
    return F.when(months.isNull(), "Never").when(months < 18, "Early").otherwise("Late")


def damage_tree(swir: Column, dnbr: Column, vv_change_db: Column, tir_anomaly: Column) -> Column:
    """Fire exposure by the optical signals, structural loss by radar, thermal anomaly where radar loss is moderate."""
    return (
        F.when((swir < 0.15) & (dnbr < 0.10), "survived_no_fire")
        .when(vv_change_db > -2.0, "survived_fire_exposed")
        .when(vv_change_db <= -4.0, "total_loss")
        .when((tir_anomaly >= 1.5) & (swir >= 0.25), "total_loss")
        .otherwise("partial_damage")
    )


def damage_confidence(swir: Column, damage: Column, vv_change_db: Column) -> Column:
    """How sure the tree's class is."""
    strong = (damage == "total_loss") & (vv_change_db <= -4.0) & (swir >= 0.30)
    return F.when((damage == "survived_no_fire") | strong, "high").when(damage.isin("survived_fire_exposed", "total_loss"), "medium").otherwise("low")


def rebuild_stage(delta_db: Column) -> Column:
    """Stage by the difference from the baseline; a cleared lot scatters less than rubble does."""
    return (
        F.when(delta_db < -8.0, "cleared_lot").when(delta_db < -6.0, "destroyed").when(delta_db < -4.0, "foundation_framing")
        .when(delta_db <= -1.5, "structure_substantial").when(delta_db > -1.5, "rebuild_complete")
    )


def valid_step(before: Column, stage: Column) -> Column:
    """Whether a stage may follow the one before; the first may be any."""
    out = before.isNull()
    for a, after in VALID_TRANSITIONS:
        out = out | ((before == a) & stage.isin(after))
    return out


def severity_rank(condition: Column) -> Column:
    """0 is worst; an unknown class has no rank."""
    return F.when(condition == "Destroyed", 0).when(condition == "Damaged", 1).when(condition == "Unaffected", 2)


def as_boolean(text: Column) -> Column:
    """True for true spellings, else null."""
    return F.when(F.lower(text.cast("string")) == "true", True)


def milestone_confidence(occupancy: Column, framing: Column, foundation: Column, demolition: Column) -> Column:
    return F.when(occupancy.isNotNull() | framing.isNotNull(), "high").when(foundation.isNotNull() | demolition.isNotNull(), "medium").otherwise("low")


def stage_weight(confidence: Column) -> Column:
    return F.when(confidence == "high", 1.0).when(confidence == "medium", 0.6).otherwise(0.3)
