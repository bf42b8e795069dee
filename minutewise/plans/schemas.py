"""Schemas and the two systems' constants."""

from __future__ import annotations

from dataclasses import dataclass

FAULTS = {"bank": "level string, component string, timestamp double, datetime string, reason string", "telecom": "level string, reason string, component string, timestamp long, datetime string"}
METRICS = (
    "horizon int, base_rate double, pr_auc double, pr_auc_lo double, pr_auc_hi double, roc_auc double, threshold double, tp int, fp int, fn int, tn int, precision double, recall double, f1 double, "
    "n_events int, events_detected int, event_recall double, median_lead_min double, false_alarms_per_day double, test_days int, pr_lift double, fold string, epochs_run double, seconds int"
)
HISTORY = "horizon int, epoch int, train_loss double, val_pr_auc double, best_epoch int, fold string"
EVENTS = "horizon int, onset string, component string, reason string, detected boolean, lead_min double, fold string"
SPLIT = "horizon int, fold string, split string, days string, windows int, positive int, shape string, clipped_share double"
PREP = "fold string, series_raw int, dropped_not_every_train_day int, dropped_over_80pct_missing int, series_kept int, missing_after_ffill_train double, missing_after_ffill_all double"
PREDICTIONS = "horizon int, fold string, timestamp long, y int, score float, alarm boolean"
DRIFT = "day date, split string, feature string, scaled_mean double, positive_rate double"
STUDY = (
    "lookback int, hidden int, seed long, params int, val_pr_auc double, val_base double, test_pr_auc double, test_lo double, test_hi double, test_base double, test_roc double, best_epoch int, "
    "val_lift double, test_lift double"
)
GATES = "minute int, gate string, label string, mean double"
SALIENCY_TIME = "minute int, label string, saliency double"
SALIENCY_FEATURE = "feature string, saliency double"

#: Fixed values.
HORIZONS = [1, 3, 5, 10, 15, 30]
ALARM_SHARE = 30 / 1440
MAX_MISSING = 0.80
FILL_FACTOR = 2
NEGATIVES_PER_POSITIVE, LEAST_NEGATIVES = 5, 500
BLACKOUT = 10
LOOKBACK = 60
CLIP = 10.0
SEED = 20260916


@dataclass(frozen=True)
class SystemSpec:
    """A system: its minutes a day and its clock's offset from UTC in seconds."""

    name: str
    minutes: int
    utc_offset: int = 8 * 3600


BANK, TELECOM = SystemSpec("Bank", 1440), SystemSpec("Telecom", 360)


@dataclass(frozen=True)
class SourceSpec:
    """A metric file: `long` has one reading a row, `wide` one row a service and time with several value columns."""

    kind: str
    pattern: str
    ts_col: str
    id_col: str
    ts_unit: int = 1
    kpi_col: str = ""
    val_col: str = ""
    value_cols: tuple[str, ...] = ()
