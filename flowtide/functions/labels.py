"""Attack labels, severities and prediction fields (Column -> Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BENIGN, UNKNOWN = "BENIGN", "Unknown"

# Raw label -> category. The order matters for partial matches.
LABEL_CATEGORIES = {
    "benign": "BENIGN",
    "normal": "BENIGN",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowloris": "DoS",
    "dos slowhttptest": "DoS",
    "dos": "DoS",
    "heartbleed": "DoS",
    "ddos": "DDoS",
    "ddos attack-hoic": "DDoS",
    "ddos attack-loic-udp": "DDoS",
    "ddos attack-loic-http": "DDoS",
    "portscan": "PortScan",
    "port scan": "PortScan",
    "ftp-patator": "Brute Force",
    "ssh-patator": "Brute Force",
    "brute force": "Brute Force",
    "brute-force": "Brute Force",
    "bot": "Bot",
    "web attack  brute force": "Web Attack",
    "web attack  xss": "Web Attack",
    "web attack  sql injection": "Web Attack",
    "web attack – brute force": "Web Attack",
    "web attack – xss": "Web Attack",
    "web attack – sql injection": "Web Attack",
    "web attack-brute force": "Web Attack",
    "web attack-xss": "Web Attack",
    "web attack-sql injection": "Web Attack",
    "web attack": "Web Attack",
    "infiltration": "Infiltration",
}

# Severity by category.
BASE_SEVERITY = {
    "BENIGN": "LOW", "DoS": "HIGH", "DDoS": "CRITICAL", "PortScan": "MEDIUM", "Brute Force": "HIGH",
    "Bot": "HIGH", "Web Attack": "HIGH", "Infiltration": "CRITICAL", "Unknown": "MEDIUM",
}
LOW_CONFIDENCE = 0.55


def _first_match(cases: list[tuple[Column, str]]) -> Column:
    (cond, value), *rest = cases
    return reduce(lambda acc, c: acc.when(c[0], c[1]), rest, F.when(cond, value))


# Characters stripped around a label.
_SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def label_key(label: Column) -> Column:
    """A label without surrounding space, in lower case."""
    return F.lower(F.btrim(label.cast("string"), F.lit(_SPACES)))


def normalize_label(label: Column) -> Column:
    """Category of a raw label: exact match, then the first entry contained either way."""
    # Bound to a lambda variable, so that the key is computed once and not per branch.
    return F.transform(F.array(label_key(label)), category_of_key)[0]


def with_category(df: DataFrame, label: str, out: str) -> DataFrame:
    """``normalize_label`` as a column of ``df``; the key is a column of its own, so that the branches compile."""
    keyed = df.withColumn("_label_key", label_key(F.col(label)))
    return keyed.withColumn(out, category_of_key(F.col("_label_key"))).drop("_label_key")


def category_of_key(key: Column) -> Column:
    by_category: dict[str, list[str]] = {}
    for raw, category in LABEL_CATEGORIES.items():
        by_category.setdefault(category, []).append(raw)
    exact = _first_match([(key.isin(raws), c) for c, raws in by_category.items()])
    partial = _first_match([(key.contains(raw) | F.lit(raw).contains(key), c)
                            for raw, c in LABEL_CATEGORIES.items()])
    return F.coalesce(exact, partial, F.lit(UNKNOWN))


def assign_severity(attack: Column, confidence: Column) -> Column:
    """Base severity of the category, lowered when the confidence is low."""
    base = _first_match([(attack == a, s) for a, s in BASE_SEVERITY.items()]).otherwise("MEDIUM")
    lowered = F.when(base.isin("CRITICAL", "HIGH"), "MEDIUM").otherwise("LOW")
    return (F.when(attack == BENIGN, "LOW")
            .when(confidence < LOW_CONFIDENCE, lowered).otherwise(base))


def is_intrusion(prediction: Column) -> Column:
    """Anything but BENIGN; a null prediction counts as an intrusion."""
    return ~prediction.eqNullSafe(BENIGN)


def prediction_status(prediction: Column) -> Column:
    return F.when(is_intrusion(prediction), "Intrusion Detected").otherwise("Normal Traffic")


def max_probability(probabilities: Column) -> Column:
    """Confidence of an array of class probabilities, 1.0 when the model gives none."""
    return F.coalesce(F.round(F.array_max(probabilities), 4), F.lit(1.0))


def probability_map(classes: list[str], probabilities: Column) -> Column:
    """class -> probability with 4 decimals."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]),
                             F.transform(probabilities, lambda p: F.round(p, 4)))
