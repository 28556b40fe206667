"""Golden rows: the reference's shipped processed output (11 rows, time 0-10).

Raw columns and the expected derived columns are copied as literals; the
preset preprocessing must reproduce every derived column.
"""

import pytest
from pyspark.sql import functions as F

from vatlens.plans.preprocess import bioprocess_spec, preprocess

# Input rows and the derived columns they must give.
RAW = [
    (0, 37.09934283, 7.027987109, 78.64964345, 4.809219244, 291.365064, 99.57624032, 0.0),
    (1, 36.97234714, 7.017992674, 79.69096266, 4.910961499, 299.6879651, 99.53658589, 0.0),
    (2, 37.12953771, 7.000192607, 78.37516016, 4.952639447, 300.1801687, 98.18435683, 0.0),
    (3, 37.30460597, 6.985561264, 79.32407694, 5.179768766, 304.7263035, 99.63990981, 0.0),
    (4, 36.95316933, 7.011964466, 76.13277067, 5.043655312, 286.3314164, 100.0, 0.0),
    (5, 36.95317261, 7.005369708, 80.32658741, 4.851451843, 305.9256727, 98.67576788, 0.468577243),
    (6, 37.31584256, 7.014903864, 79.88241095, 5.030603629, 272.9560837, 100.0, 0.0),
    (7, 37.15348695, 7.009203436, 78.22582274, 4.824269601, 293.7011545, 100.0, 0.0),
    (8, 36.90610512, 7.016991054, 81.15849134, 5.084269105, 295.1172616, 99.18576668, 0.650033923),
    (9, 37.10851201, 6.984795296, 81.69514028, 4.925887535, 306.3332683, 99.76847036, 0.0),
    (10, 36.90731646, 7.021347881, 76.58488027, 4.960636381, 300.2263085, 100.0, 0.070639786),
]
# Glucose_Consumption_Rate, DO_Change, Specific_Productivity, Agitation_Normalized, flags
EXPECTED = [
    (None, None, 0.0, -0.4957478052991779, 0, 0),
    (0.10174225499999956, 1.0413192099999975, 0.0, 0.38494865497612624, 0, 0),
    (0.04167794800000024, -1.3158025000000038, 0.0, 0.43703169225441346, 0, 0),
    (0.22712931899999944, 0.9489167800000047, 0.0, 0.9180856875126711, 0, 0),
    (-0.1361134539999993, -3.1913062699999983, 0.0, -1.0283884759414486, 0, 0),
    (-0.19220346899999985, 4.193816740000003, 0.004748655653430928, 1.0449981902940941, 0, 0),
    (0.17915178599999937, -0.44417646000000843, 0.0, -2.443713255409821, 0, 0),
    (-0.20633402799999967, -1.6565882099999953, 0.0, -0.24855195261354002, 0, 0),
    (0.2599995039999996, 2.9326685999999995, 0.006553701652548439, -0.0987051028965873, 0, 0),
    (-0.15838156999999953, 0.5366489400000063, 0.0, 1.0881283438103688, 0, 0),
    (0.03474884599999939, -5.110260010000005, 0.0007063978599999999, 0.4419140233129675, 0, 0),
]
COLS = ["Time_hours", "Temperature_C", "pH", "Dissolved_Oxygen_percent", "Glucose_gL",
        "Agitation_RPM", "Cell_Viability_percent", "Product_Titer_gL"]
SCHEMA = "Time_hours long, " + ", ".join(f"{c} double" for c in COLS[1:])


@pytest.mark.parametrize("split", [True, False])
def test_golden_preprocess(spark, split):
    # column names with surrounding spaces must be stripped
    df = spark.createDataFrame(RAW, SCHEMA).toDF(*[f" {c} " for c in COLS])
    out = preprocess(df, bioprocess_spec(), strict=True, split=split).orderBy("Time_hours").collect()
    assert len(out) == 11
    for row, exp in zip(out, EXPECTED):
        got = (row["Glucose_Consumption_Rate"], row["DO_Change"], row["Specific_Productivity"],
               row["Agitation_Normalized"], row["High_Titer_Flag"], row["Low_Viability_Flag"])
        for g, e in zip(got, exp):
            if e is None:
                assert g is None
            else:
                assert g == pytest.approx(e, abs=1e-12)


def test_golden_dropna_spans_removed_rows(spark):
    """W1 runs after P2: the difference spans a dropped row."""
    rows = [r for r in RAW]
    rows[3] = (3, None, 6.98, 79.3, 5.17, 304.7, 99.6, 0.0)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["Time_hours"]: r for r in preprocess(df, bioprocess_spec()).collect()}
    assert 3 not in out
    assert out[4]["Glucose_Consumption_Rate"] == pytest.approx(RAW[4][4] - RAW[2][4], abs=1e-12)
    assert out[4]["Agitation_Normalized"] is not None
    assert F is not None
