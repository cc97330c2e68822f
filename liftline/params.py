"""Column vocabularies and parameters shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

# --- fixed values: they decide the results, so they are stated plainly -------
EPSILON = 1e-9
PRICE_SMOOTHING = 0.05
PRICE_SPIKE = 0.50
IQR_FACTOR = 1.5
MIN_BLOCK_WEEKS = 1
METRIC_DECIMALS = 2

HISTORY_WEEKS = 203
HORIZON_WEEKS = 12
SLOTS = 52
SLOT_GATE = 104
LAGS = (1, 2, 3, 4)
RECENT_WEEKS = 12

SLOT_SHARE = 0.05
DEFAULT_IMPACT = 0.10
DEFAULT_PRICE = 10.0
MAD_SCALE = 1.5
MAD_BOUND = 2.0
PULL_FORWARD_LEVELS = (-0.000001,)

REGION = "NATIONAL"

#: promotion columns whose lags enter the modelling table
PROMOTIONS = (
    "pa_depth", "ar_depth", "tr_depth",
    "page_back", "page_front", "page_inside",
    "cpp_flag", "digital_flag", "digest_flag",
)
#: promotion columns used by the forecast and the insights
PROMOS = (
    "pa_depth", "ar_depth", "tr_depth",
    "flyer_flag", "cpp_flag", "digital_flag", "digest_flag",
)
DEPTHS = ("pa_depth", "ar_depth", "tr_depth")
FLAGS = ("flyer_flag", "cpp_flag", "digest_flag", "digital_flag")
PAGES = ("page_front", "page_back", "page_inside")

NO_PROMO = "No_Promo"
INSTORE_ONLY = "Instore_Only"
#: multiplier metric per promo class
MULTIPLIERS = {
    "Instore_Flyer": "M_instore_flyer",
    "Instore_CPP": "M_instore_cpp",
    "Instore_Flyer_CPP": "M_instore_flyer_cpp",
}
# --- end of fixed values ------------------------------------------------------

SERIES = ("upc", "store")
GROUP = "group_code"
WEEK = "yr_wk"
#: what names a group series: the back-test origin (where there is one), the department and the group
KEYS = ("origin", "dept", GROUP)


def keys_of(columns: Iterable[str]) -> list[str]:
    """The key columns among the given ones: a group in two departments is two series."""
    have = set(columns)
    return [k for k in KEYS if k in have]


def lag_name(promo: str, k: int) -> str:
    return f"{promo}_lag_{k}"


LAG_COLUMNS = tuple(lag_name(p, k) for k in LAGS for p in PROMOTIONS)


@dataclass(frozen=True)
class AnomalyParams:
    """Which weeks may be repaired, and how."""

    shock_weeks: tuple[int, ...] = ()
    include_promo: bool = False
    seasonal: bool = False
    scale: float = MAD_SCALE
    bound: float = MAD_BOUND


@dataclass(frozen=True)
class ModelParams:
    anomaly: AnomalyParams = field(default_factory=AnomalyParams)
    price_fill: str = "average"  # or "mode"
    head: int = len(LAGS)
