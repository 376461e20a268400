"""Every query against its SQL at the smallest scale.

The costly ones run only with ALL_QUERIES=1.
"""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from workload.registry import ORACLES, QUERIES
from tests.conftest import DATA

SLOW = {
    "scenario_nested", "split_arr_dep", "attach_profiles", "dropped_profiles", "noncommercial_fleet",
    "noncommercial_emissions", "airport_emissions", "commercial_fleet", "commercial_emissions", "facility_match",
    "cascade_match", "facility_county_check", "knn_distance", "coded_fleet", "facility_fleet", "fill_single_donor",
    "fill_min_ops_donor", "aviation_type_mix", "stage_apu_lookup", "report_fleet", "dashboard_county", "heli_emissions",
    "farm_fleet", "military_heli_fleet", "unit_fleet", "aircraft_candidates", "fleet_mix_audit", "epa_code_map",
}
NAMES = [n for n in QUERIES if os.environ.get("ALL_QUERIES") or n not in SLOW]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return "~"
        if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)):
            return f"{float(x):.6g}"
        return str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    mine = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)
    assert len(mine) > 0


def test_entry(spark):
    assert {"l_suppkey", "p_type", "fleetmix"} <= set(entry.entry(spark).columns)
