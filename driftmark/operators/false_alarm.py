"""What a window rule costs: binomial bounds on false alarms, and rules that keep a budget."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_count(n_frames: int, window: int, step: int) -> int:
    return 0 if n_frames < window else (n_frames - window) // step + 1


def binomial_tail(least: int, trials: int, p: float) -> float:
    """P(X >= least) for X ~ Binomial(trials, p), summed in logarithms."""
    if least <= 0:
        return 1.0
    whole, logs = math.lgamma(trials + 1), []
    for k in range(least, trials + 1):
        logs.append(whole - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p))
    if not logs:
        return 0.0
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def effective_trials(window: int, rho: float = 0.0, beads: int = 1) -> int:
    """Independent chances to flag in a window of an AR(1) series."""
    if window < 1 or beads < 1:
        raise ValueError("window and beads must be at least 1")
    rho = min(max(float(rho), 0.0), 0.99)
    return max(1, round(window * (1 - rho) / (1 + rho) * beads))


def trials(rho: Column, window: int, beads: int = 1) -> Column:
    """The same of a column; halves go to the even number, as in Python."""
    rho = F.greatest(F.lit(0.0), F.least(F.lit(0.99), rho))
    return F.greatest(F.lit(1), F.bround(F.round(F.lit(float(window)) * (1 - rho) / (1 + rho) * F.lit(beads), 6), 0)).cast("long")


def flags_needed(fraction: float, trials: int) -> int:
    return min(max(math.ceil(fraction * trials - 1e-9), 1), trials)


def _share(name: str, value: float, closed: bool = False) -> None:
    if not (0 < value < 1 or closed and value == 1):
        raise ValueError(f"{name} must be between 0 and 1, not {value}")


def false_alarm_bound(alpha: float, window: int, fraction: float, windows: int = 1, rho: float = 0.0, beads: int = 1) -> float:
    """Union bound on the chance that the rule fires anywhere in a clean run."""
    _share("alpha", alpha)
    _share("fraction", fraction, closed=True)
    trials = effective_trials(window, rho, beads)
    return min(1.0, binomial_tail(flags_needed(fraction, trials), trials, alpha) * max(windows, 1))


def loosest_fraction(budget: float, alpha: float, window: int, windows: int = 1, rho: float = 0.0, beads: int = 1) -> tuple[float, float]:
    """The smallest fraction whose bound fits the budget, and that bound."""
    _share("budget", budget)
    trials = effective_trials(window, rho, beads)
    for m in range(1, trials + 1):
        bound = min(1.0, binomial_tail(m, trials, alpha) * max(windows, 1))
        if bound <= budget:
            return m / trials, bound
    raise ValueError(f"no fraction keeps a budget of {budget} with {trials} trials and {windows} windows")


def design_report(alpha: float, window: int, step: int, n_frames: int, fraction: float, rho: float = 0.0, beads: int = 1) -> dict:
    windows, disjoint = window_count(n_frames, window, step), max(1, n_frames // window)
    trials = effective_trials(window, rho, beads)
    bound = lambda n: false_alarm_bound(alpha, window, fraction, n, rho, beads)
    return {
        "false_flag_rate": alpha, "window_frames": window, "step_frames": step, "fraction_threshold": fraction,
        "frame_autocorrelation": rho, "n_effective_beads": beads, "n_windows_tested": windows,
        "effective_trials_per_window": trials, "flags_needed_per_window": flags_needed(fraction, trials),
        "expected_false_flags_per_frame_series": alpha * n_frames, "frames_to_first_false_flag": 1 / alpha,
        "false_alarm_probability_per_window": bound(1), "false_alarm_probability_per_run": bound(windows),
        "false_alarm_probability_per_run_nonoverlapping": bound(disjoint), "n_disjoint_windows": disjoint,
    }


def resolve_rule(config: dict, alpha: float, n_frames: int, measured_rho: float | None = None) -> tuple[float, dict]:
    """The fraction to use, from the config's fraction or from its budget, with its report."""
    window, step, beads = int(config["window_frames"]), int(config["step_frames"]), int(config.get("n_effective_beads", 1))
    rho = config.get("frame_autocorrelation", 0.0)
    if isinstance(rho, str):
        if rho != "auto":
            raise ValueError(f"frame_autocorrelation is a number or 'auto', not {rho!r}")
        rho = measured_rho or 0.0
    elif rho == 0:
        warnings.warn("independent frames are assumed, which makes the bound optimistic", stacklevel=2)
    budget = config.get("false_alarm_budget")
    if budget is None:
        fraction = float(config["fraction_threshold"])
    else:
        fraction, _ = loosest_fraction(float(budget), alpha, window, window_count(n_frames, window, step), rho, beads)
        if config.get("fraction_threshold") is not None and not math.isclose(config["fraction_threshold"], fraction):
            warnings.warn("the budget overrides the configured fraction", stacklevel=2)
    report = design_report(alpha, window, step, n_frames, fraction, rho, beads) | {"derived_from_false_alarm_budget": budget}
    return fraction, report


def two_track_rule(config: dict, bead_percentile: float, centroid_percentile: float, n_frames: int, rho: float | None = None) -> tuple[float, dict]:
    """One fraction for both tracks: the stricter of the two where their percentiles differ."""
    fraction, report = resolve_rule(config, 1 - bead_percentile / 100, n_frames, rho)
    if centroid_percentile == bead_percentile:
        return fraction, report
    other, second = resolve_rule(config, 1 - centroid_percentile / 100, n_frames, rho)
    return max(fraction, other), {"fraction_threshold_used": max(fraction, other), "bead": report, "centroid": second}
