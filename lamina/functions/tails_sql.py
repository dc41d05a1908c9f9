"""Tail probabilities as SQL text, for engines that have lgamma but no distributions; the checks of registered queries use them."""

from __future__ import annotations


def normal_sf(z: str) -> str:
    """P(Z >= z) by the series of erf with positive terms only; beyond 12 deviations it is 0."""
    x = f"least(greatest(abs({z}) / sqrt(2::DOUBLE), 1e-200), 8.5)"
    erf = f"least(1, 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 160), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2)))))"
    return f"CASE WHEN {z} >= 0 THEN (1 - {erf}) / 2 ELSE (1 + {erf}) / 2 END"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| >= |t|) for a whole number of degrees of freedom, by its finite series."""
    c2, s = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    term = lambda coefficient, last: f"coalesce(list_sum(list_transform(range(0, CAST({last} AS BIGINT)), lambda k: exp({coefficient} + k * ln({c2})))), 0)"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c2}) * {term('lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)', f'({df} - 1) // 2')})"
    even = f"{s} * {term('lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)', f'{df} // 2')}"
    return f"greatest(0, 1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 1 THEN {odd} ELSE {even} END)"
