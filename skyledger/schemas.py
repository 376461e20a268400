"""Declared schemas of the delimited inputs, as DDL text."""

from __future__ import annotations

def _schema(text: str) -> str:
    return " ".join(text.split())


FACILITY_REGISTRY = _schema("""
    facility_id string, facility_name string, effective_date string, city string, county string,
    state string, facility_type string, airport_status_code string, ownership string, used string,
    medical_use string, other_services string, fuel_types string, military_joint_use string,
    single_engine_ga double, multi_engine_ga double, jet_engine_ga double, helicopters_ga double,
    gliders_operational double, military_operational double, ultralights double,
    operations_commercial double, operations_commuter double, operations_air_taxi double,
    operations_ga_local double, operations_ga_itin double, operations_military double,
    operations_date string, arp_latitude string, arp_longitude string""")

PLANNING_GROUP = _schema("""
    facility_id string, region_id string, tx_dot string, airport_name string, city string,
    airport_type string""")

FORECAST = _schema("""
    facility_id string, region string, aport_name string, city string, state string, fac_type int,
    atct_flag int, hub_size string, sysyear int, scenario int, ac int, commuter int, t_enpl int,
    itn_ac int, itn_at int, itn_ga int, itn_mil int, t_itn int, loc_ga int, loc_mil int, t_loc int,
    t_aops int, t_trops int, tot_ba int""")

TRAFFIC = _schema("""
    date string, year_id int, month_name string, season string, facility_id string, airport string,
    city string, flight_type string, user_class string, weight_class string, physical_class string,
    aircraft_id string, aircraft_type_id string, aircraft_type string, business_jet string,
    regional_jet string, business_aviation string, airplane_approach_cat string,
    airplane_design_grp string, taxiway_design_grp string, departures int, arrivals int,
    total_ops int, departure_seats int, average_departure_seats int, arrival_seats int,
    average_arrival_seats int""")

TAXI_TIME = _schema("""
    facility_id string, date string, year int, month_name string, season string, hour int,
    quarter int, departures_metrics int, avg_taxi_out_time double, arrivals_metrics double,
    avg_taxi_in_time double""")

REPORTED_OPS = _schema("""
    facility_id string, reported_operations string, extracted_num double,
    frequency_multiplier double, annual_operations double, operations_year int,
    military_ops double, transient_ga_ops double, local_ga_ops double, commercial_ops double,
    air_taxi_ops double""")

OWN_OPS = _schema("""
    facility_id string, ops_2019 double, ops_2020 double, summer_2019 double, summer_2020 double""")

PRIOR_INVENTORY = _schema("""
    facility_id string, airport string, county string, fip int, scc bigint, scc_description string,
    aetc int, airframe string, engine string, mode string, lto double, eis_pollutant_id string,
    uncontrolled_annual_emis_st double, controlled_annual_emis_st double,
    uncontrolled_daily_emis_st double, controlled_daily_emis_st double""")

COUNTY_CORRECTION = _schema("""
    facility_id string, city_arpt string, county_arpt string, district_tx_boundar string,
    fips_tx_boundar int""")

OPS_FINAL = _schema("""
    facility_id string, facility_name string, facility_group string, annual_operations string,
    summer_daily string""")

AIRCRAFT_MAP = _schema("""
    aircraft_id string, aircraft_type string, engine_type string, aircraft_type_id string,
    aircraft_id_and_type string, closest_airframe_id_aedt int, closest_airframe_type_aedt string,
    justification string""")

EMISSION_RATES = _schema("""
    event_id string, departure_airport string, arrival_airport string, equipment_type string,
    mode string, num_ops double, fuel_st double, distance_mi double, duration double, co_st double,
    thc_st double, tog_st double, voc_st double, nmhc_st double, nox_st double,
    nvpm_mass_st double, nvpm_number double, pmso_st double, pmfo_st double, co2_st double,
    h2o_st double, sox_st double, pm25_st double, pm10_st double, operation_id string,
    user_id string, operation_time string""")

EIS = _schema("""
    state_facility_identifier string, airport string, facility_group string, facility_type string,
    county string, fip int, district string, scc bigint, scc_description string, airframe string,
    engine string, airframe_engine_code string, mode string, ltos double, eis_pollutant_id string,
    uncontrolled_annual_emis_st double, controlled_annual_emis_st double,
    uncontrolled_daily_emis_st double, controlled_daily_emis_st double""")

ALL = {
    "facility_registry": FACILITY_REGISTRY, "planning_group": PLANNING_GROUP, "forecast": FORECAST,
    "traffic": TRAFFIC, "taxi_time": TAXI_TIME, "reported_ops": REPORTED_OPS, "own_ops": OWN_OPS,
    "prior_inventory": PRIOR_INVENTORY, "county_correction": COUNTY_CORRECTION,
    "ops_final": OPS_FINAL, "aircraft_map": AIRCRAFT_MAP, "emission_rates": EMISSION_RATES,
    "eis": EIS,
}
