"""The whole load on a small shipyard: six CSV sources, two runs."""

from datetime import datetime

import pytest
from conftest import rows

from starmill.plans import shipyard
from starmill.plans.load import LoadPlan, SilverTable, run_load
from starmill.sources.lake import Lake

BUYERS = """raw_buyer_id,source_system,external_buyer_id,buyer_ref,email,title,forename,surname,telephone,mobile,address1,address2,city,postcode,country,marketing_optin,load_ts,source_file
1,ERP,B1,BR1,a@b.c,Ms,Ada,Lund,1,2,Quay 1,,Oslo,0150,Norway,Y,2023-01-01 00:00:00,buyers.csv
2,ERP,B2,BR2,nomail,Mr, Bo ,Berg,1,2,Quay 2,,Oslo,0151,Norway,N,2023-01-01 00:00:00,buyers.csv
3,ERP,B3,BR3,c@d.e,Mr,Cy,Dahl,1,2,Quay 3,,Oslo,0152,{country},maybe,2023-01-01 00:00:00,buyers.csv
"""
SUBCONTRACTORS = """raw_subcontractor_id,source_system,external_subcontractor_id,subcontractor_ref,class_society_code,name,email,telephone,title,forename,surname,address1,address2,city,postcode,country,payment_method,load_ts,source_file
1,ERP,S2,SR2,IACS-00002,Steel,s@t.u,1,Mr,Al,Ek,Dock 1,,Riga,1,Latvia,SEPA,2023-01-01 00:00:00,s.csv
2,ERP,S1,SR1,IACS-00001,Paint,p@t.u,1,Ms,Bea,Ek,Dock 2,,Riga,1,Latvia,SWIFT,2023-01-01 00:00:00,s.csv
"""
VESSELS = """raw_vessel_id,source_system,external_vessel_id,vessel_ref,vessel_class,brand,name,address1,address2,address3,city,postcode,resort,area,region,country,withdrawn_date,miles_from_sea,margin_rate,value_tier,value_tier_start,has_helideck,ice_class,deck_count,complement,rating,contract_type,date_created,date_live,load_ts,source_file
1,ERP,V1,VR1,Tug,PortMaster,Alpha,Y1,,,Oslo,1,R,A,N,Norway,,0,9.5,{tier},2022-02-11 00:00:00,Y,N,1,3,4.8,Lease,2019-11-25 00:00:00,2022-11-14 00:00:00,2023-07-23 00:00:00,v.csv
2,ERP,V2,VR2,Tug,PortMaster,Beta,Y2,,,Oslo,1,R,A,N,Norway,2024-12-29 00:00:00,5,7.25,Standard,2022-02-11 00:00:00,N,Y,2,4,4.0,Lease,2019-11-25 00:00:00,2022-11-14 00:00:00,2023-07-23 00:00:00,v.csv
"""
SLOTS = """raw_slot_id,external_vessel_id,slot_date,is_closed,allocation,booked_by_buyer,booked_by_yard,actual_available,potential_available,load_ts,source_file
1,V1,2023-05-01 00:00:00,N,4,1,0,3,4,2023-07-23 00:00:00,b.csv
2,V1,2023-05-02 00:00:00,Y,0,0,0,0,0,2023-07-23 00:00:00,b.csv
3,V9,2023-05-01 00:00:00,N,3,1,0,2,3,2023-07-23 00:00:00,b.csv
"""
ORDERS = """raw_order_id,source_system,external_order_id,order_reference,external_buyer_id,external_vessel_id,created_ts,confirmed_ts,cancelled_ts,cancellation_reason,build_start,build_end,total_price,total_cost,crew_officers,crew_ratings,crew_cadets,brand,spec_package,finance_fee,order_fee,cancellation_fee,is_owner_order,sales_channel,channel_group,load_ts,source_file
1,ERP,O1,R1,B1,V1,2023-03-01 10:00:00,2023-03-02 10:00:00,,,2023-04-01 00:00:00,2023-05-01 00:00:00,100.555,60.25,2,1,0,PortMaster,Basic,1.5,2.5,0,N,Broker,Indirect,2023-07-23 00:00:00,o.csv
2,ERP,O2,R2,B3,V2,2023-03-05 10:00:00,,2023-03-06 10:00:00,Budget,2023-04-01 00:00:00,,50,70,2,1,0,PortMaster,Basic,1.5,2.5,5,Y,Broker,Indirect,2023-07-23 00:00:00,o.csv
3,ERP,O3,R3,B7,V2,2023-03-05 10:00:00,,,,2023-04-01 00:00:00,,50,40,2,1,0,PortMaster,Basic,1.5,2.5,5,Y,Direct Tender,Direct,2023-07-23 00:00:00,o.csv
"""
LINES = """raw_line_id,raw_order_id,external_order_id,line_type,line_name,sequence,line_reference,external_subcontractor_id,external_vessel_id,start_date,end_date,duration_days,price,cost,price_currency,cost_currency,price_fx_rate,cost_fx_rate,status,cancelled_ts,created_ts,crew_officers,crew_ratings,crew_cadets,load_ts,source_file
1,1,O1,Hull,H,1,L1,S1,V1,2023-04-01 00:00:00,2023-04-11 00:00:00,10,10.10,5,GBP,EUR,1.1725,1.0,Ordered,,2023-03-01 10:00:00,1,1,1,2023-07-23 00:00:00,l.csv
2,1,O1,Trials,T,2,L2,S2,,2023-04-01 00:00:00,2023-04-11 00:00:00,10,20,5,EUR,EUR,1.0,1.0,Cancelled,2023-03-03 00:00:00,2023-03-01 10:00:00,1,1,1,2023-07-23 00:00:00,l.csv
"""


def soft(**rule):
    return {"severity": "soft", "max_fail_rate": 0.5, **rule}


CONTRACTS = {
    "buyers": {"table": "buyers", "rules": {
        "not_null": {"severity": "hard", "columns": ["external_buyer_id"]},
        "unique": {"severity": "hard", "columns": ["external_buyer_id"]},
        "regex": soft(checks={"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$"})}},
    "orders": {"table": "orders", "rules": {
        "referential_integrity": {"severity": "hard", "max_fail_rate": 0.0, "checks": [
            {"column": "external_buyer_id", "parent_table": "buyers", "parent_column": "external_buyer_id"}]}}},
}


def write_sources(folder, country="Norway", tier="Premium"):
    texts = {
        "buyers": BUYERS.format(country=country), "subcontractors": SUBCONTRACTORS,
        "vessels": VESSELS.format(tier=tier), "build_slots": SLOTS, "orders": ORDERS, "order_lines": LINES,
    }
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"raw_{name}.csv").write_text(text)
    return str(folder)


def plan_(**more):
    return LoadPlan(shipyard.SILVER, shipyard.gold_tables, CONTRACTS, **more)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("yard")
    first = run_load(spark, write_sources(base / "in1"), str(base / "lake"), plan_(), datetime(2024, 1, 1), "run1")
    second_in = write_sources(base / "in2", country="Sweden", tier="Flagship")
    second = run_load(spark, second_in, str(base / "lake"), plan_(), datetime(2024, 2, 1), "run2")
    return Lake(spark, str(base / "lake")), first, second


def test_summary(loaded):
    _, first, _ = loaded
    assert first["bronze"] == {"buyers": 3, "subcontractors": 2, "vessels": 2, "build_slots": 3, "orders": 3, "order_lines": 2}
    buyers = first["silver"]["tables"]["buyers"]
    assert (buyers["row_count_promoted"], buyers["row_count_quarantined"]) == (2, 1)
    assert first["silver"]["blocked"] == ["orders"] and first["status"] == "blocked"
    assert first["gold"]["dim_date"] == 1461 and first["gold"]["fact_orders"] == 2
    assert first["silver"]["contract_summary"]["total_quarantined"] == 2


def test_silver_and_quarantine(loaded):
    lake, _, _ = loaded
    assert rows(lake.read("silver", "buyers"), "external_buyer_id", "marketing_optin") == [("B1", True), ("B3", None)]
    assert rows(lake.read("quarantine", "buyers"), "forename", "_quarantine_reasons") == [("Bo", "regex_email")]
    assert rows(lake.read("quarantine", "orders"), "external_order_id", "_quarantine_reasons") == [
        ("O3", "ri_external_buyer_id")]
    assert "address2" not in lake.read("silver", "vessels").columns


def test_histories_after_two_runs(loaded):
    lake, _, second = loaded
    at = datetime(2024, 2, 1)
    assert rows(lake.read("gold", "dim_buyer"), "buyer_id", "country", "full_name", "buyer_sk", "eff_end_ts") == [
        ("B1", "Norway", "Ada Lund", 1, None), ("B3", "Norway", "Cy Dahl", 2, at), ("B3", "Sweden", "Cy Dahl", 3, None)]
    vessels = rows(lake.read("gold", "dim_vessel"), "vessel_id", "value_tier", "is_withdrawn", "vessel_sk")
    assert vessels == [("V1", "Flagship", False, 3), ("V1", "Premium", False, 1), ("V2", "Standard", True, 2)]
    assert second["gold"]["dim_vessel"] == 3


def test_facts_resolve_the_version_of_the_day(loaded):
    lake, _, _ = loaded
    orders = rows(lake.read("gold", "fact_orders"), "order_sk", "order_id", "buyer_sk", "vessel_sk", "channel_sk",
                  "date_created_sk", "is_cancelled", "build_days", "total_price_eur", "margin_eur")
    assert orders == [
        (1, "O1", 1, 1, 1, 20230301, False, 30, 100.56, 40.31),
        (2, "O2", 2, 2, 1, 20230305, True, None, 50.0, -20.0),
    ]
    lines = rows(lake.read("gold", "fact_order_lines"), "line_sk", "subcontractor_sk", "vessel_sk", "price_eur",
                 "margin_eur", "is_cancelled")
    assert lines == [(1, 1, 1, 11.84, 6.84, False), (2, 2, None, 20.0, 15.0, True)]
    slots = rows(lake.read("gold", "fact_build_slots"), "vessel_sk", "date_sk", "utilization_rate")
    assert slots == [(1, 20230501, 0.25), (1, 20230502, None), (None, 20230501, 0.3333)]


def test_run_history(loaded):
    lake, _, _ = loaded
    log = lake.read("gold", "run_history")
    assert rows(log, "run_id", "pipeline_status", "failed_scripts") == [
        ("run1", "blocked", ["orders"]), ("run2", "blocked", ["orders"])]


def test_halting(spark, tmp_path):
    folder = write_sources(tmp_path / "in")
    halted = run_load(spark, folder, str(tmp_path / "a"), plan_(fail_fast=True), datetime(2024, 1, 1), "r")
    assert halted["silver"]["halted_at"] == "orders" and halted["gold"] == {} and halted["status"] == "halted"
    assert "order_lines" not in halted["silver"]["tables"]


def test_a_run_that_raises_is_logged_and_leaves_nothing_behind(spark, tmp_path):
    from starmill.sources.workdir import work_dir
    from starmill.sources.files import list_names

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "raw_things.csv").write_text("id,v\n1,a\n")
    before = list_names(spark, work_dir(spark))
    plan = LoadPlan([SilverTable("missing", ["id"])], lambda at: [], {})
    with pytest.raises(LookupError):
        run_load(spark, str(folder), str(tmp_path / "lake"), plan, datetime(2024, 1, 1), "bad")
    run = Lake(spark, str(tmp_path / "lake")).read("gold", "run_history").first()
    assert run.pipeline_status == "failed" and "LookupError" in run.execution_logs
    assert list_names(spark, work_dir(spark)) == before


def test_halt_reason_and_kept_columns(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "raw_things.csv").write_text("id,address2,address3\n1,,x\n2,,\n")
    contract = {"table": "things", "schema": {"required_columns": ["gone"]}, "rules": {}}
    plan = LoadPlan([SilverTable("things", ["id"], drop=["address2", "address3"])], lambda at: [],
                    {"things": contract}, fail_fast=True)
    summary = run_load(spark, str(folder), str(tmp_path / "lake"), plan, datetime(2024, 1, 1), "r")
    assert summary["status"] == "halted" and summary["silver"]["halted_at"] == "things"
    assert summary["silver"]["tables"]["things"]["kept_columns"] == ["address3"]
    lake = Lake(spark, str(tmp_path / "lake"))
    assert "missing columns: gone" in lake.read("gold", "run_history").first().execution_logs
    assert "address2" not in lake.read("silver", "things").columns
