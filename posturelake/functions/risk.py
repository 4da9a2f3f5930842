"""Risk scoring (RSK-01 to RSK-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .enums import lookup

# Fixed values of the formula: weights, terms and what an unknown value counts as.
WEIGHTS = {"impact": 0.40, "exploitability": 0.20, "exposure": 0.20, "privilege": 0.10, "sensitivity": 10.0}
IMPACT = ({"informational": 1.0, "low": 2.0, "medium": 3.0, "high": 4.0, "critical": 4.0}, 1.0)
EXPLOITABILITY = ({"low": 2.0, "medium": 3.0, "high": 4.0}, 2.0)
EXPOSURE = ({"local": 0.5, "loopback": 1.0, "container": 2.0, "virtual": 2.5, "vpn": 3.0, "lan": 3.5, "wildcard": 4.0, "public": 4.0, "unknown": 2.0}, 2.0)
PRIVILEGE = ({"none": 4.0, "user": 3.0, "elevated": 2.0, "system": 1.0}, 2.0)
SENSITIVITY = ({"public": 0.0, "internal": 0.25, "sensitive": 0.5, "secret": 1.0}, 0.0)
CONFIDENCE = ({"confirmed": 1.0, "observed": 0.9, "probable": 0.7, "possible": 0.4, "unknown": 0.15, "not_observed": 0.25}, 0.15)
FORMULA = "score = (0.40*impact + 0.20*exploitability + 0.20*exposure + 0.10*privilege)*25 + sensitivity_bonus*10; then * confidence_weight. Inputs scored 0-4."
BANDS = ((90, "critical"), (75, "high"), (55, "elevated"), (35, "moderate"), (15, "low"))


def exploitability(exposure: Column, privilege: Column) -> Column:
    """RSK-03: inferred from the terms of exposure and privilege."""
    return F.when(exposure >= 3.5, "high").when((exposure >= 2) | (privilege >= 3), "medium").otherwise("low")


def band(score: Column) -> Column:
    """RSK-04."""
    out = F.lit("minimal")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score(severity: Column, exposure: Column, privilege: Column, sensitivity: Column, confidence: Column) -> Column:
    """RSK-01, RSK-02 and RSK-05: a struct of every term, ``risk_raw``, ``risk_score`` and ``risk_band`` (of the unrounded score)."""
    e, p = lookup(exposure, *EXPOSURE), lookup(privilege, *PRIVILEGE)
    guess = exploitability(e, p)
    terms = {"impact_term": lookup(severity, *IMPACT), "exploitability_term": lookup(guess, *EXPLOITABILITY), "exposure_term": e, "privilege_term": p, "sensitivity_term": lookup(sensitivity, *SENSITIVITY), "confidence_term": lookup(confidence, *CONFIDENCE)}
    w = WEIGHTS
    raw = (w["impact"] * terms["impact_term"] + w["exploitability"] * terms["exploitability_term"] + w["exposure"] * e + w["privilege"] * p) * 25 + w["sensitivity"] * terms["sensitivity_term"]
    raw = F.least(raw, F.lit(100.0))
    final = raw * terms["confidence_term"]
    named = [c.alias(n) for n, c in terms.items()]
    return F.struct(*named, guess.alias("exploitability"), F.lit(True).alias("exploitability_inferred"), F.round(raw, 1).alias("risk_raw"), F.round(final, 1).alias("risk_score"), band(final).alias("risk_band"))
