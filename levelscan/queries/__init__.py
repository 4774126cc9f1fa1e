"""All registered queries."""

from levelscan.queries import aggregates, alarms, fits, indicators, joins, learners, projections, ranking, series, statistics, streams, texts, windows  # noqa: F401
from levelscan.queries.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, folder):
    return QUERIES["alm07_alarm_metrics"](spark, folder)
