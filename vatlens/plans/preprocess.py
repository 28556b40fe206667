"""Shared preprocessing (P1-P10, W1, A9) as one lazy plan, and the bioprocess preset.

``preprocess(df, spec)`` = strip names -> drop incomplete rows -> per-run
first differences -> safe ratios -> z-scores (statistics of this frame) ->
0/1 threshold flags. ``strict=True`` fails when an input column is missing
(the CLI); ``strict=False`` derives only what the inputs allow (the app).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.operators import cleaning, ordered, summary


@dataclass
class FeatureSpec:
    """What to derive. Mappings are output-name keyed where the order matters."""

    order_by: list[str]
    partition_by: list[str] = field(default_factory=list)
    diffs: dict[str, str] = field(default_factory=dict)          # source -> output
    ratios: dict[str, tuple[str, str]] = field(default_factory=dict)  # output -> (num, den)
    zscores: dict[str, str] = field(default_factory=dict)        # source -> output
    flags: dict[str, tuple[str, str, float]] = field(default_factory=dict)  # output -> (col, op, thr)
    target: str | None = None

    def inputs(self) -> set[str]:
        s = set(self.diffs) | set(self.zscores) | {c for c, _, _ in self.flags.values()}
        for a, b in self.ratios.values():
            s |= {a, b}
        return s


def preprocess(df: DataFrame, spec: FeatureSpec, strict: bool = False,
               drop_missing: bool = True, split: bool = True,
               zscore_stats: dict | None = None) -> DataFrame:
    """Apply ``spec``; output = input columns + derived columns, in spec order.

    ``zscore_stats`` ({column: {"mean", "std"}}) uses stored statistics
    instead of the frame's own (scoring with the training statistics).
    """
    df = cleaning.strip_column_names(df)
    cols = set(df.columns)
    if strict:
        missing = sorted(spec.inputs() - cols)
        if missing:
            raise ValueError(f"missing input columns: {missing}")
    if drop_missing:
        df = cleaning.drop_incomplete(df)
    base_cols = df.columns
    # z-scores first: their statistics need only the input column, so the
    # aggregate scans the source instead of re-running the difference
    # windows; the rows are the same (differences drop no rows)
    zs = {s: o for s, o in spec.zscores.items() if s in cols}
    if zs:
        if zscore_stats:
            df = df.withColumns({
                o: F.when(F.lit(zscore_stats[s]["std"] or 0.0) == 0, F.lit(0.0)).otherwise(
                    (F.col(s) - F.lit(zscore_stats[s]["mean"])) / F.lit(zscore_stats[s]["std"] or 1.0))
                for s, o in zs.items()})
        else:
            df = summary.zscore(df, zs)
    diffs = {s: o for s, o in spec.diffs.items() if s in cols}
    if diffs:
        order_ok = all(c in cols for c in spec.order_by)
        if not order_ok:
            raise ValueError(f"order columns not found: {spec.order_by}")
        df = ordered.diff(df, diffs, spec.order_by, spec.partition_by or None, split=split)
    ratios = {o: (a, b) for o, (a, b) in spec.ratios.items() if a in cols and b in cols}
    if ratios:
        df = df.withColumns({o: cleaning.safe_ratio(a, b) for o, (a, b) in ratios.items()})
    fl = {o: t for o, t in spec.flags.items() if t[0] in cols}
    if fl:
        df = df.withColumns({o: cleaning.flag(c, op, thr) for o, (c, op, thr) in fl.items()})
    derived = [*diffs.values(), *ratios, *zs.values(), *fl]
    return df.select(*base_cols, *derived)


def derived_columns(spec: FeatureSpec) -> list[str]:
    return [*spec.diffs.values(), *spec.ratios, *spec.zscores.values(), *spec.flags]


# --------------------------------------------------------------------------
# Bioprocess preset. Fixed values that must equal the reference's for the
# same results: the raw column names, the derived column names, the flag
# thresholds (titer > 1 g/L, viability < 98 %) and the feature order of the
# shipped feature schema.
RAW_COLUMNS = ["Time_hours", "Temperature_C", "pH", "Dissolved_Oxygen_percent",
               "Glucose_gL", "Agitation_RPM", "Cell_Viability_percent", "Product_Titer_gL"]
TARGET = "Product_Titer_gL"
FEATURES = ["Time_hours", "Temperature_C", "pH", "Dissolved_Oxygen_percent", "Glucose_gL",
            "Agitation_RPM", "Cell_Viability_percent", "Glucose_Consumption_Rate", "DO_Change",
            "Specific_Productivity", "Agitation_Normalized", "High_Titer_Flag",
            "Low_Viability_Flag"]
PREDICTION = "Pred_Product_Titer_gL"
KPI_COLUMNS = ["Temperature_C", "pH", "Dissolved_Oxygen_percent", "Product_Titer_gL"]
DEFAULT_THRESHOLD = 5.0
DEFAULT_CONDITION = "above"


def bioprocess_spec(run: str | None = None) -> FeatureSpec:
    """The reference's derivations; the file is one run unless ``run`` is given."""
    return FeatureSpec(
        order_by=["Time_hours"],
        partition_by=[run] if run else [],
        diffs={"Glucose_gL": "Glucose_Consumption_Rate", "Dissolved_Oxygen_percent": "DO_Change"},
        ratios={"Specific_Productivity": ("Product_Titer_gL", "Cell_Viability_percent")},
        zscores={"Agitation_RPM": "Agitation_Normalized"},
        flags={"High_Titer_Flag": ("Product_Titer_gL", ">", 1),
               "Low_Viability_Flag": ("Cell_Viability_percent", "<", 98)},
        target=TARGET,
    )
