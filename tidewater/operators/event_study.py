"""Known events against daily bars: were they flagged when they came?"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import FEATURES, SETTINGS, Settings

from .cep.detector import CepDetector
from .detectors.ewma import Ewma
from .detectors.iforest import IsolationForest
from .enrich import anchored

#: Days before and after an event, rows at least, rows that the forest sees at least and keeps away from the event, rows around it that count.
BEFORE, AFTER, LEAST, FIT, CLEAR, REACH = 160, 8, 40, 20, 3, 2
#: The detectors without the sequence model.
WEIGHTS = {"ewma": 0.45, "hst": 0.05, "isolation_forest": 0.50}
STUDY = "ticker string, event_day long, day long, offset int, ml_score double, ml_flag boolean, cep_score double, cep_flag boolean, cep_match string"


def event_study(daily: DataFrame, events: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The rows around each event (ticker, day) with both methods' scores and flags; events with too short a history have none."""
    located = anchored(daily, events, REACH).select("ticker", "event_day", F.col("day").alias("located"))
    rows = daily.join(F.broadcast(located), "ticker").where((F.col("day") >= F.col("event_day") - BEFORE) & (F.col("day") <= F.col("event_day") + AFTER))

    def study(pdf: pd.DataFrame) -> pd.DataFrame:
        from .detectors.hst import HalfSpaceTrees

        pdf = pdf.sort_values("day", ignore_index=True)
        at = pdf.index[pdf["day"] == pdf["located"]]
        columns = [c.split()[0] for c in STUDY.split(", ")]
        if len(pdf) < LEAST or not len(at):
            return pd.DataFrame(columns=columns)
        at, out = int(at[0]), []
        fit = max(FIT, at - CLEAR)
        forest = IsolationForest(seed=s.seed).fit(pdf.loc[: fit - 1, list(FEATURES)].to_numpy(float))
        learners = [Ewma(s.ewma_span), HalfSpaceTrees(s.hst_trees, s.hst_height, s.hst_window, s.seed), forest]
        cep = CepDetector(s)
        weight = sum(WEIGHTS.values())
        for i, row in enumerate(pdf.to_dict("records")):
            ml = sum(WEIGHTS[m.name] * m.score(row) for m in learners) / weight
            score = cep.score(row)
            for m in learners:
                m.update(row)
            cep.update(row)
            if abs(i - at) <= REACH:
                out.append((row["ticker"], row["event_day"], row["day"], i - at, ml, ml < s.threshold, score, score < s.cep_threshold, cep.match))
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy("ticker", "event_day").applyInPandas(study, STUDY)
