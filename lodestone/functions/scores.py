"""Score columns. Time always comes in as ``as_of`` (epoch seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# BM25 constants and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# The score of a hit in a name, title or alias.
NAME_SCORE = 1_000_000.0
DAY = 86_400.0


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def idf(df, n_docs) -> Column:
    df, n_docs = _c(df), _c(n_docs)
    # A term may be counted on a newer table than n_docs; keep the logarithm defined.
    missing = F.greatest(n_docs - df, F.lit(0)) + 0.5
    return F.greatest(F.log(missing / (df + 0.5)), F.lit(IDF_FLOOR))


def bm25(tf, n_tokens, df, n_docs, avg_tokens) -> Column:
    """Okapi BM25, negated: the best hit has the lowest score."""
    tf = _c(tf).cast("double")
    norm = (1.0 - B) + B * _c(n_tokens) / _c(avg_tokens)
    return -idf(df, n_docs) * (tf * (K1 + 1.0)) / (tf + K1 * norm)


def query_affinity(clicks: Column, last_clicked_at: Column, as_of) -> Column:
    age = F.greatest(_c(as_of) - last_clicked_at, F.lit(0.0))
    return clicks / (clicks + 2.0) * (1.0 / (1.0 + age / (30 * DAY)))


def utility(clicks: Column, importance: Column, mtime: Column, as_of) -> Column:
    popularity = clicks / (clicks + 10.0)
    weight = F.least(F.greatest(importance / 1000.0, F.lit(0.0)), F.lit(1.0))
    age = F.greatest(_c(as_of) - mtime, F.lit(0.0))
    recency = 1.0 / (1.0 + age / (90 * DAY))
    return 0.55 * popularity + 0.25 * weight + 0.20 * recency


def non_negative(value: Column, kind: str = "bigint") -> Column:
    """Number of the given kind, at least 0; 0 for anything unreadable.

    Fractions lose what is behind the point, true counts as 1.
    """
    loose = F.when(F.lower(value.cast("string")) == "true", 1.0).otherwise(value.try_cast("double"))
    number = F.coalesce(value.try_cast(kind), F.when(~F.isnan(loose), loose).try_cast(kind))
    return F.coalesce(F.greatest(number, F.lit(0).cast(kind)), F.lit(0).cast(kind))


def log_score(value: Column) -> Column:
    return F.least(F.log1p(non_negative(value)) / F.log1p(F.lit(50.0)), F.lit(1.0))


def recency(millis: Column, as_of, half_life_days: float) -> Column:
    at = non_negative(millis, "double")
    now = _c(as_of) * 1000.0
    age_days = (now - at) / (1000.0 * DAY)
    fresh = F.pow(F.lit(0.5), age_days / half_life_days)
    return F.when((at > 0) & (at <= now), fresh).otherwise(0.0)


# Weight of each access metric in the importance score.
IMPORTANCE_WEIGHTS = {
    "backlinkCount": 0.28,
    "accessCount": 0.22,
    "outgoingLinkCount": 0.08,
    "tagCount": 0.06,
    "headingCount": 0.05,
    "attachmentCount": 0.05,
}
# Weight and half-life in days of each time metric.
IMPORTANCE_TIMES = {"lastOpenedAt": (0.16, 21), "modifiedAt": (0.1, 45)}


def importance(metric, as_of) -> Column:
    """Importance 0..1000; ``metric(name)`` gives the column of one metric."""
    total = F.lit(0.0)
    for name, weight in IMPORTANCE_WEIGHTS.items():
        total = total + weight * log_score(metric(name))
    for name, (weight, half_life) in IMPORTANCE_TIMES.items():
        total = total + weight * recency(metric(name), as_of, half_life)
    return F.round(1000.0 * total, 6)


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def ts_to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6
