"""Monthly panel, model comparison, diagnostics and forecast report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from regiotally.functions.calendar import month_label
from regiotally.functions.labels import before_colon
from regiotally.functions.numeric import per_head, round_even
from regiotally.operators.combine import one_hot
from regiotally.operators.diagnostics import (
    inflation_factors,
    paired_t,
    paired_t_test,
    quantile_line,
    quantile_plot,
    shapiro_wilk,
)
from regiotally.operators.linear import LASSO, OLS, RIDGE, LinearFit, fit_rows, fit_subset
from regiotally.operators.panel import add_lags, add_season, complete_months, split_years
from regiotally.operators.position import checkpointed
from regiotally.operators.scaling import fit_scaler
from regiotally.operators.summary import by_magnitude, top
from regiotally.operators.validation import best_alpha, combined, fold_blocks, mean_error, placed_moments
from regiotally.plans.explore import target_cells
from regiotally.plans.spec import Study


def panel_rows(merged: DataFrame, study: Study, by_calendar: bool = False) -> DataFrame:
    """One row per region and month with rate, season, lags and region flags; incomplete rows dropped.

    Lags count rows of the region. With ``by_calendar`` missing months are added first, so that they count
    months.
    """
    return panel_of_cells(target_cells(merged, study, digits=2), study, by_calendar)


def panel_of_cells(cells: DataFrame, study: Study, by_calendar: bool = False) -> DataFrame:
    """The same from cells whose rates have two digits."""
    c, p = study.incidents, study.panel
    if by_calendar:
        cells = complete_months(cells, c.region, c.year, c.month)
    rated = cells.withColumns(
        {p.log_rate: F.log1p(p.rate), p.per_head: per_head(p.supply[1], p.population)}
    )
    lagged = add_lags(add_season(rated, c.month), c.region, [c.year, c.month], p.rate, (1, 3), p.lag_prefix)
    flagged = one_hot(lagged, c.region, p.levels, p.reference, p.dummy_prefix)
    known = [*p.lags, p.rate] if by_calendar else p.lags
    return flagged.na.drop(subset=known)


@dataclass(frozen=True)
class Model:
    name: str
    kind: str
    alpha: float
    fit: LinearFit
    cv_rmse: float


@dataclass
class Forecast:
    """Models of one panel, which ``of`` checkpoints: a row per region and month, read many times.

    Building the panel and every fit start jobs when a result first needs them, so a method that returns a table of
    models has done its work when it returns; tables of rows are lazy beyond the fits they use. ``train`` and ``test`` are
    conditions in SQL. Keep one ``Forecast`` for several reports: fits and panel are shared.
    """

    panel: DataFrame
    study: Study
    train: str
    test: str
    time_order: bool = False
    scale: str = "global"

    @classmethod
    def of_panel(cls, panel: DataFrame, study: Study, train, test, **options) -> "Forecast":
        return cls(checkpointed(panel), study, train, test, **options)

    @classmethod
    def of(cls, merged: DataFrame, study: Study, train, test, **options) -> "Forecast":
        return cls.of_panel(panel_rows(merged, study), study, train, test, **options)

    @property
    def target(self) -> str:
        return self.study.panel.log_rate

    @property
    def order(self) -> list[str]:
        """Row order of the folds: by region and month, or by month alone for folds in true time order."""
        c = self.study.incidents
        return [c.year, c.month, c.region] if self.time_order else [c.region, c.year, c.month]

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame]:
        return split_years(self.panel, self.train, self.test)

    @cached_property
    def _all_features(self) -> list[str]:
        return list(dict.fromkeys(f for v in self.study.panel.variants.values() for f in v))

    @cached_property
    def _rough(self):
        """Mean and deviation of every feature over all rows, and the row count."""
        return fit_scaler(self.panel, self._all_features)

    @cached_property
    def _moments(self):
        """The one pass that all fits on feature sets, folds and alphas share."""
        marked = self.panel.withColumn("_train", F.coalesce(F.expr(self.train), F.lit(False)))
        return placed_moments(
            marked, self._all_features, self.target, self.order, self._rough, "_train", self.study.folds
        )

    @cached_property
    def _training(self):
        """Scaler and moments of the training rows, out of the shared pass."""
        return self._rough.refined(combined(m for (_, train), m in self._moments.items() if train), self._all_features)

    # Feature sets ---------------------------------------------------------------------------------

    @cached_property
    def _variant_errors(self) -> list[tuple[str, int, float, float]]:
        """All feature sets fitted from the shared moments and scored in one pass over the test rows."""
        variants = self.study.panel.variants
        scaler, moments = self._training
        fits = [fit_subset(moments, self._all_features, v, OLS) for v in variants.values()]
        scored = scaler.apply(self.parts[1], self._all_features)
        sums = []
        for i, fit in enumerate(fits):
            error = F.col(self.target) - fit.column()
            sums += [F.sqrt(F.avg(error * error)).alias(f"rmse{i}"), F.avg(F.abs(error)).alias(f"mae{i}")]
        row = scored.agg(*sums).first()
        return [(n, len(v), row[f"rmse{i}"], row[f"mae{i}"]) for i, (n, v) in enumerate(variants.items())]

    def variants(self) -> DataFrame:
        """Error of each feature set on the test rows; the smallest RMSE is chosen, first on ties."""
        best = min(self._variant_errors, key=lambda r: r[2])[0]
        rows = [(*r, r[0] == best) for r in self._variant_errors]
        schema = "variant string, features int, rmse double, mae double, chosen boolean"
        table = self.panel.sparkSession.createDataFrame(rows, schema)
        return table.withColumn("short_name", before_colon("variant"))

    @cached_property
    def features(self) -> list[str]:
        return self.study.panel.variants[min(self._variant_errors, key=lambda r: r[2])[0]]

    def inflation(self) -> DataFrame:
        return inflation_factors(self.parts[0], self.features)

    # Tuning ---------------------------------------------------------------------------------------

    @cached_property
    def _places(self) -> list[int]:
        return [self._all_features.index(f) for f in self.features]

    @cached_property
    def _blocks(self):
        return fold_blocks(self._moments, self._places)

    @cached_property
    def _grid(self) -> dict[str, dict[float, float]]:
        return {
            kind: {a: mean_error(self._blocks, kind, a, self.scale) for a in self.study.alphas}
            for kind in (RIDGE, LASSO)
        }

    def alpha_grid(self) -> DataFrame:
        """Mean validation RMSE by penalty and alpha, the best alpha of each penalty marked."""
        best = {kind: best_alpha(errors) for kind, errors in self._grid.items()}
        rows = [(k, a, e, a == best[k]) for k, errors in self._grid.items() for a, e in errors.items()]
        return self.panel.sparkSession.createDataFrame(
            rows, "penalty string, alpha double, cv_rmse double, chosen boolean"
        )

    # Final models ---------------------------------------------------------------------------------

    @cached_property
    def models(self) -> list[Model]:
        ridge, lasso = best_alpha(self._grid[RIDGE]), best_alpha(self._grid[LASSO])
        jobs = [(OLS, 0.0), (RIDGE, ridge), (LASSO, lasso)]
        scaler, moments = self._training
        train = scaler.apply(self.parts[0], self.features)
        fits = fit_rows(train, self.features, self.target, jobs, moments.only(self._places))
        errors = [mean_error(self._blocks, k, a, self.scale) for k, a in jobs]
        names = ["Linear Regression", f"Ridge (a={ridge:g})", f"Lasso (a={lasso:g})"]
        return [Model(n, k, a, f, e) for n, (k, a), f, e in zip(names, jobs, fits, errors)]

    @cached_property
    def best(self) -> Model:
        return min(self.models, key=lambda m: m.cv_rmse)

    def scored(self) -> DataFrame:
        """Test rows with the prediction of every model, on the log scale, side by side."""
        rows = self._training[0].apply(self.parts[1], self.features)
        return rows.withColumns({f"pred_{m.kind}": m.fit.column() for m in self.models})

    def leaderboard(self) -> DataFrame:
        """Test and validation errors of the three models; the smallest validation RMSE is chosen."""
        sums = []
        for i, m in enumerate(self.models):
            error = F.col(self.target) - F.col(f"pred_{m.kind}")
            back = F.expm1(self.target) - F.expm1(f"pred_{m.kind}")
            sums += [
                F.sqrt(F.avg(error * error)).alias(f"rmse{i}"),
                F.avg(F.abs(error)).alias(f"mae{i}"),
                F.sqrt(F.avg(back * back)).alias(f"rmse_rate{i}"),
            ]
        row = self.scored().agg(*sums).first()
        rows = [
            (m.name, m.kind, m.alpha, row[f"rmse{i}"], row[f"mae{i}"], row[f"rmse_rate{i}"], m.cv_rmse, m is self.best)
            for i, m in enumerate(self.models)
        ]
        schema = (
            "model string, kind string, alpha double, rmse double, mae double, rmse_rate double, "
            "cv_rmse double, chosen boolean"
        )
        return self.panel.sparkSession.createDataFrame(rows, schema)

    def coefficients(self) -> DataFrame:
        """Standardised ridge and lasso coefficients, largest ridge magnitude first."""
        by_kind = {m.kind: m.fit for m in self.models}
        rows = list(zip(self.features, by_kind[RIDGE].coefficients, by_kind[LASSO].coefficients))
        table = self.panel.sparkSession.createDataFrame(rows, "feature string, ridge double, lasso double")
        return by_magnitude(table.withColumn("lasso_zeroed", F.abs("lasso") < 1e-6), "ridge", "feature")

    # Diagnostics ----------------------------------------------------------------------------------

    def residuals(self) -> DataFrame:
        """Fitted values and residuals of the plain linear model on the test rows."""
        c = self.study.incidents
        fitted = F.col(f"pred_{OLS}")
        return self.scored().select(
            c.region, c.year, c.month, fitted.alias("fitted"), (F.col(self.target) - fitted).alias("residual")
        )

    def normality(self) -> DataFrame:
        c = self.study.incidents
        return shapiro_wilk(self.residuals(), "residual", [c.region, c.year, c.month])

    def quantiles(self) -> DataFrame:
        c = self.study.incidents
        return quantile_plot(self.residuals(), "residual", [c.region, c.year, c.month])

    def quantile_fit(self) -> DataFrame:
        return quantile_line(self.quantiles())

    def _errors(self) -> tuple[DataFrame, dict[str, str]]:
        errors = {f"error_{m.kind}": F.col(self.target) - F.col(f"pred_{m.kind}") for m in self.models}
        return self.scored().withColumns(errors), {m.name: f"error_{m.kind}" for m in self.models}

    def paired_statistics(self) -> DataFrame:
        return paired_t(*self._errors())

    def significance(self) -> DataFrame:
        return paired_t_test(*self._errors())

    # Forecast -------------------------------------------------------------------------------------

    def predictions(self, kind: str | None = None) -> DataFrame:
        """Forecast of the chosen model, or of the ``kind`` asked for."""
        return forecast_table(self.scored(), f"pred_{kind or self.best.kind}", self.study)


def forecast_table(scored: DataFrame, predicted: str, study: Study) -> DataFrame:
    """Actual and predicted rates per region and month. Errors are taken of the rounded rates."""
    c, p = study.incidents, study.panel
    rates = scored.select(
        c.region,
        c.year,
        c.month,
        month_label(c.month).alias("month_label"),
        F.expm1(p.log_rate).alias("actual_exact"),
        F.expm1(predicted).alias("predicted_exact"),
    )
    rounded = rates.withColumns(
        {"actual": round_even("actual_exact", 1), "predicted": round_even("predicted_exact", 1)}
    ).withColumn("error", round_even(F.col("predicted") - F.col("actual"), 1))
    pct = round_even(F.try_divide("error", "actual") * 100, 1)
    return rounded.withColumns({"pct_error": pct, "abs_error": F.abs("error")})


def report_by_region(table: DataFrame, region: str) -> DataFrame:
    error = F.col("error")
    return table.groupBy(region).agg(
        F.avg("actual").alias("avg_actual"),
        F.avg("predicted").alias("avg_predicted"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg("pct_error").alias("mean_pct_error"),
    ).orderBy(region)


def overall_errors(table: DataFrame) -> DataFrame:
    """RMSE and MAE of the unrounded rates."""
    error = F.col("predicted_exact") - F.col("actual_exact")
    return table.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def closest(table: DataFrame, study: Study, k: int = 5) -> DataFrame:
    c = study.incidents
    return top(table, k, "abs_error", c.region, c.year, c.month)


def farthest(table: DataFrame, study: Study, k: int = 5) -> DataFrame:
    c = study.incidents
    return top(table, k, F.col("abs_error").desc(), c.region, c.year, c.month)
