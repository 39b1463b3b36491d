"""Fixed values of the detection rules: window sizes, version labels, reason and explanation codes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PivotTier:
    kind_group: str
    left: int
    right: int
    structure_version: str
    rulebook_version: str = "v0_2"
    created_reason: str = "left_window_satisfied"
    confirmed_reason: str = "right_window_completed"
    invalidated_reason: str = "right_window_violation"
    replaced_reason: str = "same_side_more_extreme"
    cross_session_code: str = "cross_session_window"

    @property
    def codes(self) -> tuple[str, ...]:
        return (f"left_window_{self.left}", f"right_window_{self.right}", "strict_tie_rule")


@dataclass(frozen=True)
class FamilyRules:
    rulebook_version: str
    structure_version: str
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reasons:
    created: str
    confirmed: str
    invalidated: str
    updated: str = "derived_state_changed"


# Fixed values.
PIVOT_ST = PivotTier("pivot_st", 2, 2, "v1")
PIVOT = PivotTier("pivot", 3, 3, "v2")
PIVOT_V1 = PivotTier("pivot", 5, 5, "v1", rulebook_version="v0_1")
PIVOT_V1_CODES = ("window_5x5", "strict_tie_rule")

LEG_V1 = FamilyRules("v0_1", "v1", ("pivot_chain_v1", "alternating_extreme_pivots"))
LEG_V2 = FamilyRules("v0_2", "v2", ("pivot_v0_2_chain", "alternating_extreme_structural_pivots"))
MAJOR_LH_V1 = FamilyRules("v0_1", "v1")
MAJOR_LH_V2 = FamilyRules("v0_2", "v2")

LEG_REASONS = Reasons("end_pivot_visible", "end_pivot_confirmed", "pivot_pair_no_longer_visible")
MAJOR_LH_REASONS = Reasons(
    "lower_high_visible", "proving_leg_broke_prior_low", "candidate_no_longer_survives"
)

SAME_TYPE_REPLACEMENT = "same_type_replacement"
CROSS_SESSION_LEG = "cross_session_leg"
LOWER_HIGH = "lower_high"
PRIOR_LOW_BROKEN = "down_leg_break_prior_low"
CROSS_SESSION_SEQUENCE = "cross_session_sequence"
LEG_STRENGTH_THRESHOLD = 0.0

RTH_OPEN_MINUTE = 570
RTH_CLOSE_MINUTE = 975
ETH_OPEN_MINUTE = 1080
SESSION_ROLL_HOURS = 6
EVENING_HOUR = 18
OVERLAY_VERSION = "v1"
