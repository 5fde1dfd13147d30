"""Estimators by name, with parameters, fit, predict, score and summary. Each is a thin face of the operators.

fit takes a formula, or a response and columns. Fitted values end in an underscore.
"""

from __future__ import annotations

import inspect
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formula as formulas
from .functions.losses import get_loss
from .functions.penalties import AdaptiveL1, NoPenalty, Penalty, get_penalty
from .operators import cox, glm, linear, models, panel_models, resampling, testing
from .plans import linear as linear_sum


class NotFitted(RuntimeError):
    pass


class Estimator:
    """Parameters are those of the constructor; a clone has the same and is not fitted."""

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in inspect.signature(type(self).__init__).parameters if k != "self"}

    def set_params(self, **parameters) -> Estimator:
        known = self.get_params()
        for k, v in parameters.items():
            if k not in known:
                raise ValueError(f"no parameter {k!r}")
            setattr(self, k, v)
        return self

    def clone(self) -> Estimator:
        return type(self)(**self.get_params())

    def _check(self) -> None:
        if not hasattr(self, "coef_"):
            raise NotFitted(f"{type(self).__name__} is not fitted")

    def _data(self, df: DataFrame, y: str | None, x: Sequence[str] | None, formula: str | None, weight: str | None = None) -> tuple[DataFrame, str, list[str], list[str]]:
        """(rows, response, columns, names of terms)."""
        if formula is None:
            self.design_ = None
            return df, y, list(x), list(x)
        self.design_ = formulas.parse(formula, df)
        rows, names, columns = self.design_.frame(df, [weight] if weight else [])
        return rows, "y0", columns, names

    def _terms(self) -> list[Column]:
        return [c for _, c in self.design_.columns()] if self.design_ is not None else [F.col(c).cast("double") for c in self.names_]

    def adjust_pvalues(self, spark, method: str = "bh") -> DataFrame:
        """The coefficients' p-values, adjusted together."""
        self._check()
        return testing.adjust(self.table_.withColumn("id", F.monotonically_increasing_id()), "p", method, "id")

    @staticmethod
    def bootstrap(df: DataFrame, statistic: Column, id_col: str, **how) -> DataFrame:
        return resampling.bootstrap(df, statistic, id_col, **how)

    @staticmethod
    def permutation_test(df: DataFrame, statistic: Column, value: str, id_col: str, **how) -> DataFrame:
        return resampling.permutation_test(df, statistic, value, id_col, **how)


class GeneralizedLinear(Estimator):
    """Any registered loss with any registered penalty."""

    def __init__(self, loss: str = "squared_error", penalty: str = "none", alpha: float = 1.0, loss_kwargs: dict | None = None, penalty_kwargs: dict | None = None, cov_type: str = "nonrobust", max_iter: int = 100, tol: float = 1e-9):
        self.loss, self.penalty, self.alpha, self.loss_kwargs, self.penalty_kwargs = loss, penalty, alpha, loss_kwargs, penalty_kwargs
        self.cov_type, self.max_iter, self.tol = cov_type, max_iter, tol

    def _penalty(self, rows: DataFrame, y: str, x: list[str]) -> Penalty:
        return NoPenalty() if self.penalty == "none" else get_penalty(self.penalty, alpha=self.alpha, **(self.penalty_kwargs or {}))

    def fit(self, df: DataFrame, y: str | None = None, x: Sequence[str] | None = None, formula: str | None = None, weight: str | None = None) -> GeneralizedLinear:
        rows, y, x, names = self._data(df, y, x, formula, weight)
        self.fit_ = glm.fit(rows, y, x, get_loss(self.loss, **(self.loss_kwargs or {})), self._penalty(rows, y, x), weight=weight, steps=self.max_iter, tol=self.tol)
        self.names_, self.intercept_, self.coef_ = names, float(self.fit_.beta[0]), self.fit_.beta[1:]
        self.fit_.names, self.rows_, self.y_ = ["intercept", *names], rows, y
        return self

    @property
    def table_(self) -> DataFrame:
        """(term, estimate, std_err, stat, p, low, high)."""
        self._check()
        return glm.inference(self.rows_, self.y_, self.fit_, self.cov_type)

    def _eta(self) -> Column:
        self._check()
        return linear_sum([F.lit(1.0), *self._terms()], self.fit_.beta)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `predicted`, the mean."""
        return df.withColumn("predicted", self.fit_.loss.mean(self._eta()))

    def score(self, df: DataFrame, y: str) -> float:
        """R squared."""
        e = F.col(y).cast("double") - self.fit_.loss.mean(self._eta())
        r = df.agg(F.sum(e * e), F.var_pop(y), F.count(y)).first()
        return 1 - r[0] / (r[1] * r[2]) if r[1] else 0.0

    def loglikelihood(self) -> float:
        return self.fit_.loglikelihood()

    def aic(self) -> float:
        return self.fit_.aic()

    def bic(self) -> float:
        return self.fit_.bic()

    def summary(self) -> str:
        self._check()
        return glm.summary(self.rows_, self.y_, self.fit_, self.cov_type)


def _with(name: str, doc: str, **fixed) -> type[GeneralizedLinear]:
    """A GeneralizedLinear with other defaults."""

    def init(self, alpha: float = fixed.get("alpha", 1.0), penalty: str = fixed.get("penalty", "l2"), loss_kwargs: dict | None = None, penalty_kwargs: dict | None = None, cov_type: str = "nonrobust", max_iter: int = 100, tol: float = 1e-9):
        GeneralizedLinear.__init__(self, fixed["loss"], penalty, alpha, loss_kwargs, penalty_kwargs, cov_type, max_iter, tol)

    return type(name, (GeneralizedLinear,), {"__init__": init, "__doc__": doc})


LinearRegression = _with("LinearRegression", "Least squares.", loss="squared_error", penalty="none")
Ridge = _with("Ridge", "Least squares with a penalty on the mean loss of alpha / 2 times the coefficients' squares.", loss="squared_error")
Lasso = _with("Lasso", "Half the mean squared error plus alpha times the coefficients' sizes.", loss="squared_error", penalty="l1")
ElasticNet = _with("ElasticNet", "Sizes and squares; their mixing is penalty_kwargs['l1_ratio'].", loss="squared_error", penalty="elasticnet")
ScadRegression = _with("ScadRegression", "The smoothly clipped penalty.", loss="squared_error", penalty="scad")
McpRegression = _with("McpRegression", "The minimax concave penalty.", loss="squared_error", penalty="mcp")
PoissonRegression = _with("PoissonRegression", "Counts with a log link; alpha is 1 / (2 C).", loss="poisson", alpha=0.5)
GammaRegression = _with("GammaRegression", "Positive values with a log link, or loss_kwargs={'link': 'inverse'}.", loss="gamma", alpha=0.5)
InverseGaussianRegression = _with("InverseGaussianRegression", "Positive values whose variance is the mean's cube.", loss="inverse_gaussian", alpha=0.5)
NegativeBinomialRegression = _with("NegativeBinomialRegression", "Counts; the dispersion is loss_kwargs['alpha'].", loss="negative_binomial", alpha=0.5)
TweedieRegression = _with("TweedieRegression", "The power is loss_kwargs['power'].", loss="tweedie", alpha=0.5)


class AdaptiveLasso(GeneralizedLinear):
    """A lasso whose weights come from a ridge fit: small coefficients there weigh more."""

    def __init__(self, alpha: float = 1.0, nu: float = 1.0, cov_type: str = "nonrobust"):
        super().__init__("squared_error", "adaptive_l1", alpha, cov_type=cov_type)
        self.nu = nu

    def _penalty(self, rows: DataFrame, y: str, x: list[str]) -> Penalty:
        return AdaptiveL1(self.alpha, linear.ols(rows, y, x, alpha=1e-3).beta[1:], self.nu)


class LogisticRegression(GeneralizedLinear):
    """C weighs the summed loss against half the coefficients' squares."""

    def __init__(self, C: float = 1.0, cov_type: str = "nonrobust", max_iter: int = 100, tol: float = 1e-9):
        super().__init__("logistic", "l2", cov_type=cov_type, max_iter=max_iter, tol=tol)
        self.C = C

    def _penalty(self, rows: DataFrame, y: str, x: list[str]) -> Penalty:
        return glm.ridge_strength(self.C, rows.count(), True)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with p0 and p1."""
        p = 1 / (1 + F.exp(-F.greatest(F.least(self._eta(), F.lit(500.0)), F.lit(-500.0))))
        return df.withColumn("p1", p).withColumn("p0", 1 - F.col("p1"))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """df with p0, p1 and `predicted`, 1 where p1 is at least the threshold."""
        return self.predict_proba(df).withColumn("predicted", (F.col("p1") >= threshold).cast("int"))

    def score(self, df: DataFrame, y: str) -> float:
        """The share that is predicted rightly."""
        return float(self.predict(df).agg(F.avg((F.col("predicted") == F.col(y)).cast("double"))).first()[0])

    def confusion(self, df: DataFrame, y: str, threshold: float = 0.5) -> DataFrame:
        return testing.confusion(self.predict(df, threshold), y, F.col("predicted"))

    def roc(self, df: DataFrame, y: str) -> DataFrame:
        return testing.curve(self.predict_proba(df), y, "p1")

    def areas(self, df: DataFrame, y: str) -> DataFrame:
        """(auc, average_precision)."""
        return testing.auc(self.predict_proba(df), y, "p1")


class QuantileRegression(Estimator):
    def __init__(self, quantile: float = 0.5):
        self.quantile = quantile

    def fit(self, df: DataFrame, y: str | None = None, x: Sequence[str] | None = None, formula: str | None = None) -> QuantileRegression:
        rows, y, x, self.names_ = self._data(df, y, x, formula)
        beta = models.quantile_fit(rows, y, x, self.quantile)
        self.intercept_, self.coef_ = float(beta[0]), beta[1:]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._check()
        return df.withColumn("predicted", linear_sum(self._terms(), self.coef_) + self.intercept_)


class RobustRegression(GeneralizedLinear):
    """huber, bisquare or fair, with a width of epsilon times the least-squares residuals' scale."""

    def __init__(self, loss: str = "huber", epsilon: float | None = None, penalty: str = "none", alpha: float = 1.0, cov_type: str = "hc0"):
        super().__init__(loss, penalty, alpha, cov_type=cov_type)
        self.epsilon = epsilon

    def fit(self, df: DataFrame, y: str | None = None, x: Sequence[str] | None = None, formula: str | None = None) -> RobustRegression:
        rows, y, x, names = self._data(df, y, x, formula)
        self.fit_ = models.robust_fit(rows, y, x, self.loss, self.epsilon, self.penalty, self.alpha)
        self.names_, self.intercept_, self.coef_, self.rows_, self.y_ = names, float(self.fit_.beta[0]), self.fit_.beta[1:], rows, y
        self.fit_.names = ["intercept", *names]
        return self


class CoxPH(Estimator):
    """Cox's model from `Surv(time, event) ~ ...`, or a time, an event and columns."""

    def __init__(self, ties: str = "breslow", penalty: float = 0.0, cov_type: str = "nonrobust"):
        self.ties, self.penalty, self.cov_type = ties, penalty, cov_type

    def fit(self, df: DataFrame, time: str | None = None, event: str | None = None, x: Sequence[str] | None = None, formula: str | None = None, entry: str | None = None) -> CoxPH:
        if formula is None:
            self.design_, self.rows_, self.columns_, self.names_ = None, df.withColumnsRenamed({}), list(x), list(x)
        else:
            self.design_ = formulas.parse(formula, df)
            self.rows_, self.names_, self.columns_ = self.design_.frame(df, [entry] if entry else [])
            time, event = "y0", "y1"
        self.time_, self.event_ = time, event
        self.fit_ = cox.fit(self.rows_, time, event, self.columns_, entry, self.ties, self.penalty)
        self.coef_ = self.fit_.beta
        return self

    def _risk(self) -> Column:
        self._check()
        return linear_sum(self._terms(), self.coef_)

    def predict_risk_score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("risk", self._risk())

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `hazard_ratio`."""
        return df.withColumn("hazard_ratio", F.exp(self._risk()))

    def score(self, df: DataFrame, time: str, event: str) -> float:
        """The concordance; 0.5 without events."""
        c = cox.concordance(df, time, event, self._risk()).first().c
        return 0.5 if c is None else float(c)

    @property
    def table_(self) -> DataFrame:
        self._check()
        return cox.inference(self.rows_, self.time_, self.event_, self.columns_, self.fit_, self.cov_type)

    def summary(self) -> str:
        self._check()
        return cox.summary(self.rows_, self.time_, self.event_, self.columns_, self.fit_)


class PanelOLS(Estimator):
    """Fixed effects from `y ~ x | entity + time`, or a response, columns and effects."""

    def __init__(self, cov_type: str = "nonrobust"):
        self.cov_type = cov_type

    def fit(self, df: DataFrame, formula: str | None = None, y: str | None = None, x: Sequence[str] | None = None, entity: str | None = None, time: str | None = None, clusters: Sequence[str] = ()) -> PanelOLS:
        if formula is not None:
            self.design_ = formulas.parse(formula, df)
            rows, self.names_, x = self.design_.frame(df, clusters)
            y, (entity, time) = "y0", (*self.design_.effects, None, None)[:2]
        else:
            self.design_, rows, self.names_ = None, df, list(x)
        self.fit_ = panel_models.fixed_effects(rows, y, x, entity, time, self.cov_type, clusters)
        self.fit_.names, self.rows_, self.coef_ = self.names_, rows, np.asarray(self.fit_.beta)
        return self

    @property
    def table_(self) -> DataFrame:
        self._check()
        return self.fit_.table(self.rows_)
