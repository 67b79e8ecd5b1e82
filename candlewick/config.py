"""Constants of the engine.  Those that results depend on are fixed values; the rest are defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
WARMUP_BARS = 312
LABEL_HORIZON = 5
LABEL_TOUCH = 0.05
LIQ_WINDOW = 60
LIQ_MIN_OBSERVATIONS = 40
MIN_UNIVERSE = 20
REBUILD_DAYS = 15
MAX_MISSING_SESSIONS = 3
MAX_STALE_SESSIONS = 1
CONSENSUS_SHARE = 0.60
CONSENSUS_VOTERS = 10
MARKET_WIDE_SHARE = 0.50
SUSPENSION_RUN = 5
ORPHAN_GAP_DAYS = 365
ORPHAN_REMAINING = 252
SPLIT_MIN_MOVE = 0.30
SPLIT_RATIO_TOLERANCE = 0.04
# Ratios of the closes around a split, larger over smaller, in the order in which they are tried.
SPLIT_RATIOS = (2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 20.0, 100.0, 1.5, 1.25, 1.2, 4 / 3, 5 / 3, 5 / 2, 7 / 5, 3 / 2)
N_SPLITS = 5
EMBARGO = 5
CALIBRATION_FRACTION = 0.25
SEED = 42
TOP_NS = (1, 3, 5, 10)

KIND_COLUMNS = {
    "equity": ("open", "high", "low", "close", "volume"),
    "index": ("open", "high", "low", "close"),
    "futures": ("open", "high", "low", "close", "volume", "roll"),
}


@dataclass(frozen=True)
class LabelVariant:
    """A take-profit and a stop-loss level, as fractions of the close or as multiples of the ATR fraction."""

    name: str
    take_profit: float
    stop_loss: float
    atr: bool


# Fixed values.
LABEL_VARIANTS = (
    LabelVariant("5p3", 0.05, 0.03, False),
    LabelVariant("3p2", 0.03, 0.02, False),
    LabelVariant("atr1p5_1p0", 1.5, 1.0, True),
    LabelVariant("atr2p0_1p0", 2.0, 1.0, True),
    LabelVariant("atr1p0_1p0", 1.0, 1.0, True),
)
PRIMARY_VARIANT = "atr1p5_1p0"

# Features that are ranked and standardised across the symbols of a session.
CROSS_SECTIONAL = (
    "D_ret_1d_pct D_range_pct D_atr_pct D_rsi14 D_adx14 D_dist_from_52wh D_dist_from_52wl D_pos_in_52w_range D_drawdown_252 D_dvol_z20 "
    "D_dvol_z252 D_realvol_20 D_realvol_ratio_20_60 D_amihud_20 D_gap_pct D_intraday_ret_pct D_ret_skew_60 D_downside_dev_60 "
    "D_bb_pctB_20 D_donch_pos_20 D_ema20_angle_deg"
).split()


@dataclass(frozen=True)
class Series:
    """How one series is fetched, checked and joined."""

    symbol: str
    kind: str = "equity"
    exchange: str = ""
    continuous: bool = False
    has_volume: bool = True
    detect_splits: bool = True
    session_end: str = "15:30"
    lag_sessions: int = 0
    underlying: str | None = None


@dataclass(frozen=True)
class PanelConfig:
    """What a panel build depends on; its hash decides between an incremental and a full rebuild."""

    liquidity_floor: float = 0.0
    min_universe: int = MIN_UNIVERSE
    horizon: int = LABEL_HORIZON
    rebuild_days: int = REBUILD_DAYS
    features: tuple[str, ...] = ()
    cross_sectional: tuple[str, ...] = field(default_factory=lambda: tuple(CROSS_SECTIONAL))
    downcast: bool = False
