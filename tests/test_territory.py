"""The three dataflows on a hand-made territory, with expectations from pandas and numpy."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regiotally.plans import explore, forecast, prepare
from regiotally.plans.spec import POLICE_REGIONS, SUB_AREAS, territory_study

AGES = ("0-4", "5-9", "85+")
STUDY = territory_study(AGES, ("Total PAC", "Beer PAC"))
YEARS = (2024, 2025)
INCIDENTS = (
    "`Reporting Region` string, `Statistical Area 2` string, Year int, `Month number` int, `As At` string, "
    "`Offence category` string, `Offence type` string, `Alcohol involvement` string, `DV involvement` string, "
    "`Number of offences` long"
)
AREAS = ["Barkly", "Gulf", "Tanami", "East Arnhem", "Daly", "Weddell"]


def incident_table():
    rng = np.random.default_rng(20)
    rows = []
    for year, month, region in itertools.product((2023, 2024, 2025), range(1, 13), [*POLICE_REGIONS, "Unknown"]):
        if year == 2023 and month != 12:
            continue
        for category, flag, other in itertools.product(["02 Assault", "07 Theft"], ["Yes", "No"], ["Yes", "-"]):
            area = AREAS[int(rng.integers(len(AREAS)))] if region == "NT Balance" else "Any"
            rows.append((region, area, year, month, "Dec", category, "type", flag, other, int(rng.integers(1, 40))))
            if region == "NT Balance":
                rows.append((region, "Daly", year, month, "Dec", category, "type", flag, other, int(rng.integers(1, 40))))
    rows += [
        ("NT Balance", "Nowhere", 2024, 5, "Dec", "02 Assault", "type", "No", "-", 4),
        ("NT Balance", None, 2024, 5, "Dec", "02 Assault", "type", "No", "-", 5),
    ]
    return rows


def population_table():
    rng = np.random.default_rng(21)
    regions = set(POLICE_REGIONS.values())
    return [
        (year, region, status, sex, age, int(rng.integers(10, 900)))
        for year, region, status, sex, age in itertools.product(
            (2022, 2024, 2025), sorted(regions), ["Aboriginal", "Non-Aboriginal"], ["Male", "Female"], AGES
        )
    ]


def supply_tables():
    rng = np.random.default_rng(22)
    tables = {}
    for year in (2023, 2024, 2025):
        ends = [datetime.date(year, m, d) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))][: 2 if year == 2025 else 4]
        tables[year] = [
            (end, region, float(rng.integers(1000, 9999)) / 4, float(rng.integers(100, 999)))
            for end, region in itertools.product(ends, [*POLICE_REGIONS, "Elsewhere"])
        ]
    return tables


@pytest.fixture(scope="module")
def sources(spark):
    incidents = spark.createDataFrame(incident_table(), INCIDENTS)
    population = spark.createDataFrame(
        population_table(), "Year int, Region string, `Aboriginal status` string, Sex string, `Age Group` string, Population long"
    )
    supply = [
        spark.createDataFrame(rows, "`Quarter Ending` date, Region string, `Total PAC` double, `Beer PAC` double")
        for rows in supply_tables().values()
    ]
    return incidents, population, supply


@pytest.fixture(scope="module")
def merged(sources):
    incidents, population, supply = sources
    clean = prepare.clean_incidents(incidents, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    people = prepare.population_features(population, STUDY, YEARS)
    return prepare.prepare(clean, people, prepare.supply_by_quarter(supply, STUDY), STUDY)


@pytest.fixture(scope="module")
def expected():
    """The merged rows, joined at row level before grouping and filled with group means of rows."""
    names = [part.split("` ")[0].strip("` ") if "`" in part else part.split()[0] for part in INCIDENTS.split(", ")]
    facts = pd.DataFrame(incident_table(), columns=names)
    facts = facts[(facts["Reporting Region"] != "Unknown") & (facts["Year"] != 2023)]
    balance = facts["Reporting Region"] == "NT Balance"
    by_area = facts["Statistical Area 2"].map(SUB_AREAS).fillna("Top End")
    facts["Region"] = np.where(balance, by_area, facts["Reporting Region"].map(POLICE_REGIONS))
    facts["Quarter"] = (facts["Month number"] + 2) // 3
    for flag in ("Alcohol involvement", "DV involvement"):
        facts[flag] = (facts[flag] == "Yes").astype(int)
    supply = pd.DataFrame(sum(supply_tables().values(), []), columns=["end", "Region", "Total PAC", "Beer PAC"])
    supply["Region"] = supply["Region"].map(POLICE_REGIONS)
    supply["Year"] = [d.year for d in supply["end"]]
    supply["Quarter"] = [d.month // 3 for d in supply["end"]]
    cell = ["Year", "Quarter", "Region"]
    supply = supply.groupby(cell)[["Total PAC", "Beer PAC"]].sum().reset_index()
    people = pd.DataFrame(population_table(), columns=["Year", "Region", "status", "sex", "age", "n"])
    total = people.groupby(["Year", "Region"])["n"].sum().rename("Total_population").reset_index()
    dims = ["Year", "Quarter", "Month number", "Region", "Offence category", "Offence type", "Alcohol involvement", "DV involvement"]
    rows = facts.merge(supply, how="left", on=cell).merge(total, how="left", on=["Year", "Region"])
    rows = rows.groupby([*dims, "Total_population", "Total PAC", "Beer PAC"], dropna=False)["Number of offences"].sum().reset_index()
    for measure in ("Total PAC", "Beer PAC"):
        means = rows.groupby(["Region", "Quarter"])[measure].transform("mean")
        rows[measure] = rows[measure].fillna(means).round(0).astype(int)
    return rows


def test_merged_table(merged, expected):
    got = merged.toPandas()
    assert list(got.columns) == [
        "Year", "Quarter", "Month number", "Region", "Offence category", "Offence type", "Alcohol involvement",
        "DV involvement", "Total_population", "Aboriginal", "Non-Aboriginal", "Male", "Female",
        "Pop_age_04", "Pop_age_59", "Pop_age_85plus", "Total PAC", "Beer PAC", "Number of offences",
        "Region_Barkly", "Region_Big Rivers", "Region_Central Australia", "Region_East Arnhem", "Region_Top End",
    ]
    shared = list(expected.columns)
    a, b = (f[shared].sort_values(shared).reset_index(drop=True).astype(str) for f in (got, expected))
    pd.testing.assert_frame_equal(a, b)
    assert (got["Male"] + got["Female"] == got["Total_population"]).all()
    assert (got["Pop_age_04"] + got["Pop_age_59"] + got["Pop_age_85plus"] == got["Total_population"]).all()
    assert (got["Region_Top End"] == (got["Region"] == "Top End")).all()


def test_supply_of_other_years_does_not_fill_gaps(merged, expected):
    row = merged.filter("Year = 2025 AND Quarter = 3 AND Region = 'Barkly'").first()
    same = merged.filter("Year = 2024 AND Quarter = 3 AND Region = 'Barkly'").first()
    assert row["Total PAC"] == same["Total PAC"]


def test_cell_without_any_supply_fails(sources):
    incidents, population, supply = sources
    clean = prepare.clean_incidents(incidents, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    short = prepare.supply_by_quarter(supply, STUDY).filter("Region <> 'Barkly'")
    with pytest.raises(PySparkException, match="impute"):
        prepare.prepare(clean, prepare.population_features(population, STUDY, YEARS), short, STUDY).collect()


def test_a_negative_count_fails(spark, sources):
    incidents, population, supply = sources
    wrong = incidents.withColumn("Number of offences", -F.col("Number of offences"))
    clean = prepare.clean_incidents(wrong, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    with pytest.raises(PySparkException, match="is negative"):
        prepare.roll_up(clean, STUDY).select("Region").collect()


def test_stage_counts(sources):
    incidents = sources[0]
    row = prepare.stage_counts(incidents, STUDY, "Reporting Region").first()
    rows = incident_table()
    kept = [r for r in rows if r[0] != "Unknown" and r[2] != 2023]
    assert (row["loaded"], row["kept"], row["counted"]) == (len(rows), len(kept), sum(r[-1] for r in kept))


def test_a_row_without_a_region_fails(spark, sources):
    incidents, population, supply = sources
    lost = spark.createDataFrame([(None, None, *incidents.filter("Year = 2024").first()[2:])], incidents.schema)
    clean = prepare.clean_incidents(incidents.unionByName(lost), STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    people = prepare.population_features(population, STUDY, YEARS)
    with pytest.raises(PySparkException, match="no value to impute"):
        prepare.prepare(clean, people, prepare.supply_by_quarter(supply, STUDY), STUDY).collect()


def test_nulls_after_each_join(sources):
    incidents, population, supply = sources
    clean = prepare.clean_incidents(incidents, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    people = prepare.population_features(population, STUDY, YEARS)
    row = prepare.join_profile(clean, people, prepare.supply_by_quarter(supply, STUDY), STUDY).first().asDict()
    assert row["joined_Total PAC"] > 0 and row["filled_Total PAC"] == 0 and row["peopled_Total_population"] == 0


def test_counts_ride_on_the_writing_job(spark, sources, tmp_path):
    incidents, population, supply = sources
    people, quarters = prepare.population_features(population, STUDY, YEARS), prepare.supply_by_quarter(supply, STUDY)
    merged, points = prepare.prepare_observed(incidents, people, quarters, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    tracker, group = spark.sparkContext.statusTracker(), "observed"
    spark.sparkContext.setJobGroup(group, group)
    merged.write.parquet(str(tmp_path / "merged"))
    written = len(tracker.getJobIdsForGroup(group))
    row = {**points.loaded.get, **points.merged.get}
    assert len(tracker.getJobIdsForGroup(group)) == written
    assert points.row(spark).first().asDict() == row
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    clean = prepare.clean_incidents(incidents, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    want = prepare.stage_counts(incidents, STUDY, "Reporting Region").first().asDict() | prepare.join_profile(clean, people, quarters, STUDY).first().asDict()
    assert row == want and row["rows"] == spark.read.parquet(str(tmp_path / "merged")).count()


def test_cells_joined_late_are_those_of_the_merged_table(sources, merged):
    incidents, population, supply = sources
    clean = prepare.clean_incidents(incidents, STUDY, "Reporting Region", "Statistical Area 2", ["As At"])
    people = prepare.population_features(population, STUDY, YEARS)
    late = explore.joined_cells(clean, people, prepare.supply_by_quarter(supply, STUDY), STUDY)
    whole = explore.month_cells(merged, STUDY)
    assert late.columns == whole.columns
    assert sorted(map(tuple, late.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_monthly_summaries(merged, expected):
    months = explore.monthly_totals(merged, STUDY).toPandas()
    want = expected.groupby("Month number")["Number of offences"].sum()
    assert list(months["Number of offences"]) == list(want)
    assert list(months["is_peak"]) == list(want == want.max())
    people = expected.groupby(["Year", "Region"])["Total_population"].first().groupby("Year").sum()
    counts = expected.groupby(["Year", "Month number"])["Number of offences"].sum()
    rates = (counts / people.reindex(counts.index, level="Year") * 100000).round(1)
    got = explore.monthly_rate(merged, STUDY).toPandas()
    assert np.allclose(got["rate_per_100k"], rates.groupby("Month number").mean())
    assert list(got["month_label"])[:2] == ["Jan", "Feb"]


def test_wide_summaries(merged, expected):
    wide = explore.category_by_year(merged, STUDY, YEARS).toPandas().set_index("Offence category")
    want = expected.groupby(["Offence category", "Year"])["Number of offences"].sum()
    assert wide.loc["Assault", "y2025"] == want["02 Assault", 2025] and wide.loc["Theft", "y2024"] == want["07 Theft", 2024]
    assert list(wide["y2024"]) == sorted(wide["y2024"])
    population = explore.population_by_year(merged, STUDY, YEARS).toPandas()
    assert tuple(population["Region"]) == STUDY.regions
    shares = {r["flag"]: r for r in explore.involvement(merged, STUDY).collect()}
    yes = expected.loc[expected["DV involvement"] == 1, "Number of offences"].sum()
    assert shares["DV involvement"]["involved"] == yes
    assert shares["DV involvement"]["involved_pct"] == round(100 * yes / expected["Number of offences"].sum(), 1)


def panel_by_hand(expected):
    chosen = expected[expected["Offence category"] == "02 Assault"]
    keys = ["Region", "Year", "Month number"]
    grouped = chosen.groupby(keys)
    panel = pd.DataFrame(
        {
            "Assault_offences": grouped["Number of offences"].sum(),
            "Alcohol_involved": grouped["Alcohol involvement"].sum(),
            "DV_involved": grouped["DV involvement"].sum(),
            "Total_PAC": grouped["Total PAC"].first(),
            "Total_population": grouped["Total_population"].first(),
        }
    ).reset_index()
    panel["rate"] = (panel["Assault_offences"] / panel["Total_population"] * 100000).round(2)
    panel["y"] = np.log1p(panel["rate"])
    angle = 2 * np.pi * panel["Month number"] / 12
    panel["sin_month"], panel["cos_month"] = np.sin(angle), np.cos(angle)
    panel["alcohol_per_capita"] = panel["Total_PAC"] / panel["Total_population"]
    for k in (1, 3):
        panel[f"assault_rate_lag{k}"] = panel.groupby("Region")["rate"].shift(k)
    for level in ("Barkly", "Central Australia", "East Arnhem"):
        panel[f"Reg_{level}"] = (panel["Region"] == level).astype(float)
    return panel.dropna().reset_index(drop=True)


@pytest.fixture(scope="module")
def study(merged):
    return forecast.Forecast.of(merged, STUDY, "Year = 2024", "Year = 2025")


def test_panel(study, expected):
    want = panel_by_hand(expected)
    got = study.panel.orderBy("Region", "Year", "Month number").toPandas()
    assert len(got) == len(want) == 126
    for mine, other in [("log_assault_rate", "y"), *[(f, f) for f in STUDY.panel.variants["V4: + Region"]]]:
        assert np.allclose(got[mine].astype(float), want[other]), mine


def fit(x, y, alpha=0.0):
    centre, spread = x.mean(axis=0), x.std(axis=0)
    z = (x - centre) / np.where(spread == 0, 1, spread)
    gram = z.T @ z + alpha * np.eye(x.shape[1])
    weights = np.linalg.pinv(gram, rcond=1e-12) @ z.T @ (y - y.mean())
    return lambda new: y.mean() + ((new - centre) / np.where(spread == 0, 1, spread)) @ weights


def test_feature_sets_and_selection(study, expected):
    panel = panel_by_hand(expected)
    train, test = panel[panel["Year"] == 2024], panel[panel["Year"] == 2025]
    rmse = {}
    for name, features in STUDY.panel.variants.items():
        predict = fit(train[features].to_numpy(float), train["y"].to_numpy())
        rmse[name] = np.sqrt(np.mean((test["y"] - predict(test[features].to_numpy(float))) ** 2))
    got = {r["variant"]: r for r in study.variants().collect()}
    assert {k: r["rmse"] for k, r in got.items()} == pytest.approx(rmse)
    assert [k for k, r in got.items() if r["chosen"]] == [min(rmse, key=rmse.get)]
    assert got["V1: Temporal only"]["short_name"] == "V1"


def test_folds_follow_regions(study, expected):
    panel = panel_by_hand(expected)
    x = panel[study.features].to_numpy(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = panel["y"].to_numpy()
    errors = {}
    for alpha in STUDY.alphas:
        folds = []
        for k in range(1, 6):
            train = slice(0, 21 * k)
            centre = x[train].mean(axis=0)
            gram = (x[train] - centre).T @ (x[train] - centre) + alpha * np.eye(x.shape[1])
            weights = np.linalg.solve(gram, (x[train] - centre).T @ (y[train] - y[train].mean()))
            rest = slice(21 * k, 21 * (k + 1))
            predicted = y[train].mean() + (x[rest] - centre) @ weights
            folds.append(np.sqrt(np.mean((y[rest] - predicted) ** 2)))
        errors[alpha] = np.mean(folds)
    got = {r["alpha"]: r for r in study.alpha_grid().collect() if r["penalty"] == "ridge"}
    assert {a: r["cv_rmse"] for a, r in got.items()} == pytest.approx(errors, rel=1e-6)
    assert [a for a, r in got.items() if r["chosen"]] == [min(errors, key=errors.get)]


def test_leaderboard_and_forecast(study, expected):
    board = study.leaderboard().toPandas()
    assert list(board["kind"]) == ["ols", "ridge", "lasso"]
    assert board.loc[board["cv_rmse"].idxmin(), "chosen"] and board["chosen"].sum() == 1
    panel = panel_by_hand(expected)
    train, test = panel[panel["Year"] == 2024], panel[panel["Year"] == 2025].reset_index(drop=True)
    predict = fit(train[study.features].to_numpy(float), train["y"].to_numpy())
    predicted = predict(test[study.features].to_numpy(float))
    ols = board.set_index("kind").loc["ols"]
    assert ols["rmse"] == pytest.approx(np.sqrt(np.mean((test["y"] - predicted) ** 2)))
    assert ols["rmse_rate"] == pytest.approx(np.sqrt(np.mean((np.expm1(test["y"]) - np.expm1(predicted)) ** 2)))
    table = study.predictions("ols").orderBy("Region", "Month number").toPandas()
    actual, guess = np.expm1(test["y"]).round(1), np.expm1(predicted).round(1)
    error = (guess - actual).round(1)
    assert np.allclose(table["actual"], actual) and np.allclose(table["predicted"], guess)
    assert np.allclose(table["error"], error) and np.allclose(table["pct_error"], (error / actual * 100).round(1))
    report = forecast.report_by_region(study.predictions("ols"), "Region").toPandas().set_index("Region")
    barkly = test["Region"] == "Barkly"
    assert report.loc["Barkly", "rmse"] == pytest.approx(np.sqrt((error[barkly] ** 2).mean()))
    assert report.loc["Barkly", "mean_pct_error"] == pytest.approx((error / actual * 100).round(1)[barkly].mean())
    near = forecast.closest(study.predictions("ols"), STUDY).toPandas()
    order = np.argsort(error.abs().to_numpy(), kind="stable")[:5]
    assert list(near["abs_error"]) == pytest.approx(list(error.abs().to_numpy()[order]))
    assert len(forecast.farthest(study.predictions(), STUDY).collect()) == 5


def test_diagnostics_run_on_the_chosen_features(study):
    assert study.residuals().count() == 72
    assert study.normality().first()["n"] == 72
    assert study.significance().count() == 3
    table = study.coefficients().toPandas()
    assert list(table["ridge"].abs()) == sorted(table["ridge"].abs(), reverse=True)
    assert set(table["feature"]) == set(study.features)
    assert study.inflation().count() == len(study.features)


def test_no_table_stays_persisted(spark, merged):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    made = forecast.Forecast.of(merged, STUDY, "Year = 2024", "Year = 2025")
    assert made.alpha_grid().count() == 10 and all(m.fit.converged for m in made.models)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_time_order_and_fold_scaling_are_options(merged, study):
    ordered = forecast.Forecast(study.panel, STUDY, "Year = 2024", "Year = 2025", time_order=True, scale="per_fold")
    assert ordered.order == ["Year", "Month number", "Region"]
    assert ordered.alpha_grid().count() == 10
    spine = forecast.panel_rows(merged, STUDY, by_calendar=True)
    assert spine.count() == 126


def test_findings(merged, expected):
    cells = explore.target_cells(merged, STUDY)
    row = explore.findings(explore.month_cells(merged, STUDY), STUDY, YEARS).first()
    want = expected.groupby("Month number")["Number of offences"].sum()
    assert row["peak_month"] == datetime.date(2000, int(want.idxmax()), 1).strftime("%b")
    chosen = expected[expected["Offence category"] == "02 Assault"].groupby(["Region", "Year", "Month number"])["Number of offences"].sum()
    assert row["skew_raw"] == pytest.approx(chosen.skew()) and row["skew_log"] == pytest.approx(np.log1p(chosen).skew())
    wide = explore.target_by_region_year(cells, STUDY, YEARS).toPandas().set_index("Region")
    assert row["top_region"] == wide["mean_rate"].idxmax()
    assert wide["total_all"].sum() == chosen.sum()


def test_supply_trend_and_month_means(merged, expected):
    cells = explore.target_cells(merged, STUDY)
    trend = explore.supply_trend(cells, STUDY).toPandas()
    assert set(trend["period"]) == {f"{y}-Q{q}" for y in YEARS for q in (1, 2, 3, 4)}
    means = explore.target_by_month_region(cells, STUDY).toPandas()
    chosen = expected[expected["Offence category"] == "02 Assault"].groupby(["Region", "Year", "Month number"])["Number of offences"].sum()
    want = chosen.groupby(["Region", "Month number"]).mean()
    assert np.allclose(means["mean_count"], want)
