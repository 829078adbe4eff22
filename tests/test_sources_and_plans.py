from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from conftest import by_value, tuples
from surveyloom import session
from surveyloom.plans import indicator_table, metrics, survey_panel
from surveyloom.sources import files

by_value(__name__)


def test_csv_readers(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    (folder / "Investor 2015_sheet1_C4.csv").write_text('"",Account No,Text\n1,007,"a, ""b""\nline"\n2,8,NA\n')
    (folder / "Supply 2016_sheet2_C6.csv").write_text('"",Account No,Text\n1,9,Question not applicable\n')
    paths = files.select_files(spark, str(folder), "2015.*c4")
    assert len(paths) == 1 and "2015" in paths[0]
    got = files.read_survey_csv(spark, str(folder / "Investor 2015_sheet1_C4.csv"), multi_line=True)
    assert got.columns == ["account no", "text", "year", "filename"]
    assert ("007", 'a, "b"\nline', 2015, "Investor 2015_sheet1_C4.csv") in tuples(got)
    assert files.read_with_nulls(spark, str(folder), multi_line=True).filter("Text is null").count() == 2
    (folder / "Other+ 2017_x.csv").write_text('"",Text,City\n1,NA,Rome\n')
    stacked = files.read_survey_csv(spark, str(folder), multi_line=True)
    assert set(stacked.columns) == {"account no", "text", "city", "year", "filename"} and stacked.count() == 4
    assert tuples(stacked.filter("year = 2017").select("account no", "text", "city", "filename")) == [(None, "NA", "Rome", "Other+ 2017_x.csv")]


def test_sheets_from_paths(spark, tmp_path):
    for label, year, sheet in (("investor", 2015, "3_C4 Targets"), ("supply_chain", 2016, "0_Summary")):
        p = tmp_path / "raw" / label / str(year)
        p.mkdir(parents=True)
        (p / f"{sheet}.csv").write_text("key,q\n1,x\n")
    got = files.read_sheets(spark, str(tmp_path / "raw" / "*" / "*" / "*.csv"), "csv")
    assert tuples(got) == [(2015, "investor", 3, "C4 Targets", "1", "x"), (2016, "supply_chain", 0, "Summary", "1", "x")]
    (tmp_path / "raw" / "investor" / "2015" / "4_Other.csv").write_text("extra,key\nz,2\n")
    got = files.read_sheets(spark, str(tmp_path / "raw" / "*" / "*" / "*.csv"), "csv").select("sheet", "key", "q", "extra")
    assert tuples(got) == [("C4 Targets", "1", "x", None), ("Other", "2", None, "z"), ("Summary", "1", "x", None)]
    for number, columns in ((1, "key string, a long"), (2, "b string, key string")):
        rows = [("k", 1)] if number == 1 else [("y", "m")]
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "pq" / "lab" / "2015" / f"{number}_s.parquet"))
    both = files.read_parquet(spark, str(tmp_path / "pq" / "lab" / "2015" / "*"))
    assert tuples(both.select("key", "a", "b")) == [("k", 1, None), ("m", None, "y")]


def test_config_rates_and_writers(spark, frame, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps([{"year": 2015, "label": "investor", "join": "Account", "sheets": [{"lo": 0, "hi": 2}], "renames": {"a": "b"}, "drop": []}]))
    config = files.read_config(spark, str(tmp_path / "config.json")).first()
    assert config.sheets[0].hi == 2 and config.renames == {"a": "b"}
    (tmp_path / "rates.csv").write_text("year,EUR,USD\n2015,0.9,1\n2016,,1\n")
    assert tuples(files.read_rates(spark, str(tmp_path / "rates.csv"))) == [(2015, "EUR", 0.9), (2015, "USD", 1.0), (2016, "USD", 1.0)]
    df = frame("label string, year int, model string, id string", [("i", 2015, "m", "US1"), ("i", 2016, "m", "US1"), ("s", 2015, "n", None)])
    files.write_workbooks(df, str(tmp_path / "wb"))
    assert (tmp_path / "wb" / "label=i" / "year=2015").is_dir() and files.read_parquet(spark, str(tmp_path / "wb")).count() == 3
    files.write_results(df, str(tmp_path / "res"))
    assert (tmp_path / "res" / "model=n").is_dir()
    files.write_ids(df, "id", str(tmp_path / "ids"))
    assert tuples(spark.read.text(str(tmp_path / "ids"))) == [("US1",)]
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 3


def test_checkpoint_dir(spark, monkeypatch):
    class Context:
        master = "yarn"
        def getConf(self):
            return {}
        def getCheckpointDir(self):
            return None

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake())
    Fake.conf = Conf({"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.checkpoint_dir(Fake()) == "hdfs:///shared"


def load_scorer():
    return lambda texts: [{"spec": 1.0, "non": 0.0} if any(ch.isdigit() for ch in t) else {"spec": 0.25, "non": 0.75} for t in texts]


def test_metrics_and_indicator_table(frame):
    schema = "account_no long, year int, respondent string, column string, sheet string, pos int, value string"
    responses = frame(schema, [
        (1, 2015, "investor", "q1", "C1", 0, "cut 10 %"), (1, 2015, "investor", "q1", "C1", 1, "soon"), (1, 2015, "investor", "q2", "C1", 0, None),
        (2, 2015, "investor", "q1", "C1", 0, "Question not applicable"), (2, 2015, "investor", "q2", "C1", 0, "soon"), (2, 2015, "investor", "name", "Summary Data", 0, "ACME"),
        (3, 2016, "supply_chain", "q1", "C1", 0, None),
    ])
    _, labels, measured = metrics.enrich(responses, {"climate_specificity": load_scorer})
    m = {(r.account_no, r.column): (r.score_average, r.number_characters, r.number_responses) for r in measured.collect()}
    assert m[(1, "q1")] == (0.625, 12, 2) and m[(1, "q2")] == (None, None, 0) and m[(2, "q2")] == (0.25, 4, 1)
    table = {r.account_no: r for r in indicator_table.indicator_table(responses, labels, measured).collect()}
    assert table[1].maxcol == 3 and table[1].nchar_sum == 10 and table[1].prop_filled == pytest.approx(1 / 3)
    # A cell that holds both labels counts once for each.
    assert table[1].climate_specificity_label_spec_sum == 1 and table[1].climate_specificity_label_non_sum == 1
    assert table[2].percent_non_specificity == pytest.approx(2 / 3) and table[2].nchar_sum == 4
    assert table[3].maxcol == 0 and table[3].prop_filled == 0.0 and len(table[3]) == 46


def test_survey_panel(frame):
    from surveyloom.functions.rename_rules import TARGET_RULES

    cells_long = frame("file string, year int, row_no long, header string, position int, value string", [
        ("i15", 2015, 0, "Account number", 0, "7"), ("i15", 2015, 0, "3.1 was a target active?", 1, "Absolute target"), ("i15", 2015, 0, "3.3b activity type", 2, "Energy efficiency: Processes"),
        ("i15", 2015, 1, "Account number", 0, "7"), ("i15", 2015, 1, "3.1 was a target active?", 1, "Intensity target"), ("i15", 2015, 1, "3.3b activity type", 2, None),
        ("i16", 2016, 0, "Account number", 0, "7"), ("i16", 2016, 0, "3.1 was a target active?", 1, "No"),
    ])
    rows = survey_panel.topic_rows(survey_panel.topic_cells(cells_long, TARGET_RULES), survey_panel.TARGET_FIELDS)
    targets = survey_panel.targets(rows)
    got = {r.year: r for r in targets.collect()}
    assert got[2015].active_target == "Absolute target, Intensity target" and got[2016].initiative_type is None
    summary = frame("year int, `account no` string, name string, `primary industry` string, `primary isin` string, isin string", [(2015, "7", "ACME & CO", "Oil & Gas", None, "NA, US1"), (2017, "8", "B", "x", "0", None)])
    fields = {c: [c] for c in ("name", "primary industry", "primary isin", "isin", "active_target", "initiative_type", "science_based_intensity_target", "science_based_absolute_target")}
    panel = survey_panel.survey_panel({"summary": summary, "targets": targets}, fields)
    final = {(r.year, r["account no"]): r for r in survey_panel.recode(panel).collect()}
    assert final[(2015, "7")]["primary industry"] == "Oil and Gas" and final[(2015, "7")].name == "ACME & CO"
    assert final[(2015, "7")].active_target_code == 1 and final[(2016, "7")].active_target_code == 0
    assert final[(2016, "7")].isin_used == "US1" and final[(2015, "7")].fiscal_year == 2014
    assert final[(2015, "7")].initiative_type_process_efficiency == 1 and final[(2016, "7")].initiative_type_NA == 1


def test_company_ids_and_reference(frame):
    accounts = frame("`account no` string, fiscal_year int, isin string, name string", [("7", 2014, "US1", "Acme"), ("7", 2016, None, "Acme"), ("8", 2015, None, "Globex Corporation"), ("9", 2015, None, "Nobody")])
    reference = frame("ref_id string, isin string, fiscal_year int, name string, order int", [("r1", "US1", 2014, "ACME INC", 0), ("r2", "XX", 2015, "GLOBEX CORP", 1)])
    overrides = frame("key string, year_from int, year_to int, field string, value string, rank int", [("7", 2016, 2019, "ref_id", "r9", 0)])
    ids = survey_panel.company_ids(accounts, reference, overrides)
    got = {(r["account no"], r.fiscal_year): r.ref_id for r in ids.collect()}
    assert len(got) == 33 and got[("7", 2010)] == "r1" and got[("7", 2015)] == "r1" and got[("7", 2019)] == "r9" and got[("8", 2009)] == "r2" and got[("9", 2012)] is None
    panel = frame("`account no` string, fiscal_year int, scope1 double", [("7", 2014, 1.0), ("8", 2015, 2.0)])
    env = frame("ref_id string, institution_id string, fiscal_year int, tru_scope1 double", [("r1", "i1", 2014, 5.0), (None, "i2", 2014, 6.0)])
    fin = frame("ref_id string, fiscal_year int, comp_revt double", [("r1", 2014, 9.0)])
    kpi = frame("account_no string, year int, respondent string, nchar_sum long", [("7", 2015, "investor", 10), ("7", 2015, "supply_chain", 11), ("55", 2015, "investor", 1)])
    rows = [r for r in survey_panel.with_reference(panel, ids, fin, env, kpi).collect() if (r["account no"], r.fiscal_year) in (("7", 2014), ("55", 2014))]
    assert sorted((r["account no"], r.scope1, r.tru_scope1, r.comp_revt, r.nchar_sum) for r in rows if r["account no"] == "7") == [("7", 1.0, 5.0, 9.0, 10), ("7", 1.0, 5.0, 9.0, 11)]
    assert [r.nchar_sum for r in rows if r["account no"] == "55"] == [1]


def test_summary_and_prefixes(frame):
    a = frame("`Account No.` string, Organisation string, Extra string", [("1", "A", "x")])
    b = frame("account_id string, `Invitation status` string", [("2", "ok")])
    out = survey_panel.summary_rows([a, b])
    assert tuples(out.select("account no", "name", "status")) == [("1", "A", None), ("2", None, "ok")] and len(out.columns) == 32
    fin, env = survey_panel.prefixed(frame("gvkey string, datadate string", [("1", "05/31/15")]), frame("`319413 x` double, periodenddate string", [(1.0, "2015-06-30")]))
    assert fin.first().fiscal_year == 2014 and "tru_scope1_absolute" in env.columns and env.first().fiscal_year == 2015


def test_pruned_reads(spark, tmp_path):
    """Folders of other labels and years, and files of other names, are not among what is read."""
    df = spark.range(40).selectExpr("id", "if(id % 2 = 0, 'investor', 'supply_chain') AS label", "cast(2010 + id % 4 AS int) AS year")
    path = str(tmp_path / "books")
    files.write_workbooks(df, path)
    part = files.read_workbooks(spark, path, ["investor"], [2010])
    assert sorted(r.id for r in part.collect()) == [i for i in range(40) if i % 4 == 0]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "label" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all("label=investor/year=2010" in r.f for r in part.selectExpr("input_file_name() AS f").distinct().collect())
    for name in ("a_2015_c4.parquet", "b_2016.parquet"):
        spark.range(3).selectExpr("id", f"'{name}' AS origin").coalesce(1).write.parquet(str(tmp_path / "raw" / name.split(".")[0]))
    import os
    for folder in (tmp_path / "raw").iterdir():
        for f in folder.glob("part-*.parquet"):
            os.link(f, tmp_path / f"{folder.name}.parquet")
    (tmp_path / "named").mkdir()
    for f in tmp_path.glob("*.parquet"):
        os.link(f, tmp_path / "named" / f.name)
    assert {r.origin for r in files.read_selected(spark, str(tmp_path / "named"), "2015.*C4").collect()} == {"a_2015_c4.parquet"}
