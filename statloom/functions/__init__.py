"""Scalar functions of models as column expressions: links, variances, penalties' proximal maps, kernels. Losses and
distributions have modules of their own."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special

L = F.lit


def _w(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


#: Link functions of a mean m in (0, 1).
LINKS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda m: m,
    "log": lambda m: F.log(m),
    "logit": lambda m: F.log(m / (1 - m)),
    "cloglog": lambda m: F.log(-F.log(1 - m)),
    "loglog": lambda m: -F.log(-F.log(m)),
    "inverse": lambda m: 1 / m,
    "inverse_squared": lambda m: 1 / (m * m),
    "sqrt": lambda m: F.sqrt(m),
    "probit": lambda m: special.norm_ppf(m),
}

#: Variance functions of a mean m.
VARIANCES: dict[str, Callable[[Column], Column]] = {
    "gaussian": lambda m: m * 0 + 1.0,
    "binomial": lambda m: m * (1 - m),
    "poisson": lambda m: m,
    "gamma": lambda m: m * m,
    "inverse_gaussian": lambda m: m * m * m,
    "negative_binomial": lambda m: m + m * m,
    "tweedie": lambda m: F.pow(m, L(1.5)),
}


def soft(z: Column, t: float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - t, L(0.0))


def _scad(z: Column, alpha: float = 1.0, a: float = 3.7, step: float = 1.0) -> Column:
    middle = ((a - 1) * z - F.signum(z) * a * alpha * step) / (a - 1 - step)
    return F.when(F.abs(z) <= alpha * (1 + step), soft(z, alpha * step)).when(F.abs(z) <= a * alpha, middle).otherwise(z)


#: Proximal maps at z of penalties with a strength, for a step.
PROX: dict[str, Callable[..., Column]] = {
    "l1": lambda z, alpha=1.0, step=1.0: soft(z, alpha * step),
    "l2": lambda z, alpha=1.0, step=1.0: z / (1 + alpha * step),
    "elastic_net": lambda z, alpha=1.0, ratio=0.5, step=1.0: soft(z, alpha * ratio * step) / (1 + alpha * (1 - ratio) * step),
    "scad": _scad,
    "mcp": lambda z, alpha=1.0, gamma=3.0, step=1.0: _w(F.abs(z) <= gamma * alpha, soft(z, alpha * step) / (1 - step / gamma), z),
    "adaptive": lambda z, alpha=1.0, step=1.0: F.signum(z) * F.greatest(F.abs(z) - alpha * step / (1.0 + F.abs(z)), L(0.0)),
}

#: Smoothing kernels of a scaled distance u.
KERNELS: dict[str, Callable[[Column], Column]] = {
    "gaussian": lambda u: F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi),
    "epanechnikov": lambda u: _w(F.abs(u) <= 1, 0.75 * (1 - u * u), L(0.0)),
    "uniform": lambda u: _w(F.abs(u) <= 1, L(0.5), L(0.0)),
    "triangular": lambda u: _w(F.abs(u) <= 1, 1 - F.abs(u), L(0.0)),
    "biweight": lambda u: _w(F.abs(u) <= 1, 15 / 16 * F.pow(1 - u * u, L(2.0)), L(0.0)),
    "triweight": lambda u: _w(F.abs(u) <= 1, 35 / 32 * F.pow(1 - u * u, L(3.0)), L(0.0)),
    "cosine": lambda u: _w(F.abs(u) <= 1, math.pi / 4 * F.cos(math.pi / 2 * u), L(0.0)),
    "tricube": lambda u: _w(F.abs(u) <= 1, 70 / 81 * F.pow(1 - F.pow(F.abs(u), L(3.0)), L(3.0)), L(0.0)),
}

#: The same in SQL, with y, e, m, z, u or x as column names.
SQL: dict[str, dict[str, str]] = {
    "loss": {
        "squared": "0.5*(y-e)*(y-e)", "logistic": "greatest(e,0.0)+ln(1+exp(-abs(e)))-y*e", "poisson": "exp(e)-y*e", "gamma": "y*exp(-e)+e",
        "inverse_gaussian": "0.5*y*exp(-2*e)-exp(-e)", "negative_binomial": "(y+1.0)*ln(1+exp(e))-y*e", "tweedie": "exp(0.5*e)/0.5+y*exp(-0.5*e)/0.5",
        "quantile": "CASE WHEN y>=e THEN 0.3*(y-e) ELSE 0.7*(e-y) END", "huber": "CASE WHEN abs(y-e)<=1.345 THEN 0.5*(y-e)*(y-e) ELSE 1.345*(abs(y-e)-0.5*1.345) END",
        "bisquare": "CASE WHEN abs(y-e)<=4.685 THEN 4.685*4.685/6*(1-pow(1-(y-e)*(y-e)/(4.685*4.685),3)) ELSE 4.685*4.685/6 END", "fair": "1.3998*1.3998*(abs(y-e)/1.3998-ln(1+abs(y-e)/1.3998))",
    },
    "link": {"identity": "m", "log": "ln(m)", "logit": "ln(m/(1-m))", "cloglog": "ln(-ln(1-m))", "loglog": "-ln(-ln(m))", "inverse": "1/m", "inverse_squared": "1/(m*m)", "sqrt": "sqrt(m)"},
    "variance": {"gaussian": "1.0", "binomial": "m*(1-m)", "poisson": "m", "gamma": "m*m", "inverse_gaussian": "m*m*m", "negative_binomial": "m+m*m", "tweedie": "pow(m,1.5)"},
    "prox": {
        "l1": "sign(z)*greatest(abs(z)-1,0.0)", "l2": "z/2.0", "elastic_net": "sign(z)*greatest(abs(z)-0.5,0.0)/1.5",
        "scad": "CASE WHEN abs(z)<=2 THEN sign(z)*greatest(abs(z)-1,0.0) WHEN abs(z)<=3.7 THEN (2.7*z-sign(z)*3.7)/1.7 ELSE z END",
        "mcp": "CASE WHEN abs(z)<=3 THEN sign(z)*greatest(abs(z)-1,0.0)/(1-1/3.0) ELSE z END", "adaptive": "sign(z)*greatest(abs(z)-1.0/(1.0+abs(z)),0.0)",
    },
    "kernel": {
        "gaussian": "exp(-0.5*u*u)/sqrt(2*pi())", "epanechnikov": "CASE WHEN abs(u)<=1 THEN 0.75*(1-u*u) ELSE 0 END", "uniform": "CASE WHEN abs(u)<=1 THEN 0.5 ELSE 0 END",
        "triangular": "CASE WHEN abs(u)<=1 THEN 1-abs(u) ELSE 0 END", "biweight": "CASE WHEN abs(u)<=1 THEN 15.0/16*pow(1-u*u,2) ELSE 0 END", "triweight": "CASE WHEN abs(u)<=1 THEN 35.0/32*pow(1-u*u,3) ELSE 0 END",
        "cosine": "CASE WHEN abs(u)<=1 THEN pi()/4*cos(pi()/2*u) ELSE 0 END", "tricube": "CASE WHEN abs(u)<=1 THEN 70.0/81*pow(1-pow(abs(u),3),3) ELSE 0 END",
    },
}
