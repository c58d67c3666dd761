"""The operators that host every per-key kernel, in blocks of rows of a bounded size."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import FEATURES, SETTINGS, Settings
from tidewater.scratch import stored

from .cep.automata import Run
from .cep.detector import CepDetector
from .detectors.adwin import DriftMonitor
from .detectors.autoencoder import Autoencoder
from .detectors.base import Detector
from .detectors.ewma import Ewma
from .detectors.hst import HalfSpaceTrees
from .detectors.iforest import IsolationForest
from .inject import positions

#: Columns that `replay` adds.
REPLAY = "ewma double, lstm_ae double, cep double, cep_match string, events array<string>, severities map<string,double>, drifted array<string>, baseline double"


class Key:
    """All kernels of one key.  A row is scored by all, then learned by all."""

    def __init__(self, s: Settings = SETTINGS, autoencoder: Autoencoder | None = None, make_cep: Callable[[], CepDetector] | None = None, drift: bool = True) -> None:
        self.ewma, self.cep, self.drift = Ewma(s.ewma_span), make_cep() if make_cep else CepDetector(s), DriftMonitor(s.drift_delta) if drift else None
        base = autoencoder or Autoencoder()
        self.lstm = Autoencoder(base.weights, base.mean, base.std, base.length)

    def step(self, row: dict) -> tuple:
        baseline, events = self.cep.events.baseline, sorted(self.cep.events.detect(row))
        scores = self.ewma.score(row), self.lstm.score(row), self.cep.score(row)
        self.ewma.update(row)
        self.lstm.update(row)
        self.cep.update(row)
        return *scores, self.cep.match, events, {k: float(v) for k, v in self.cep.severities.items() if v > 0}, self.drift.update(row) if self.drift else [], baseline

    def warm(self, row: dict) -> None:
        """Learns without scoring: the automata and the drift monitor stay where they are."""
        self.ewma.update(row)
        self.lstm.update(row)
        self.cep.update(row)

    def state(self) -> bytes:
        """All that later scores depend on but the drift monitor: equal states score equal rows alike."""
        events = self.cep.events
        # Of births only the order counts.
        runs = [[(r.state, r.age, r.absent, r.repeats, sorted(x.born for x in m.runs).index(r.born)) for r in m.runs] for m in (*self.cep.base, *self.cep.meta)]
        said = {"ewma": self.ewma.state, "buffer": [list(x) for x in self.lstm.buffer], "baseline": events.baseline, "seen": min(events.seen, max(1, events.s.baseline_min_windows)), "runs": runs}
        return json.dumps(said).encode()

    def resume(self, state: bytes) -> Key:
        said = json.loads(state)
        self.ewma.state = said["ewma"] and [tuple(x) for x in said["ewma"]]
        self.lstm.buffer.extend(said["buffer"])
        self.cep.events.baseline, self.cep.events.seen = said["baseline"], said["seen"]
        for m, runs in zip((*self.cep.base, *self.cep.meta), said["runs"], strict=True):
            m.runs = [Run(state, age, born, absent, repeats) for state, age, absent, repeats, born in runs]
            m.clock = 1 + max((r.born for r in m.runs), default=-1)
        return self


#: Rows of a block, and rows before it that its kernels are run through first.
BLOCK, HALO = 1 << 15, 1 << 10


def blocked(features: DataFrame, order: list[str], block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Adds _place, the row's place in the order, and _block; a block's last `halo` rows are in the next one too."""
    own = F.floor(F.col("_place") / block)
    rows = positions(features, order, "_place")
    return rows.withColumn("_block", F.explode(F.when(F.col("_place") % block >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))))


def settled(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """What `run` makes of each block of `blocked` rows, once every block has started from the state in which the one before it ended.

    run: the rows of a block to those of its own, with `_place`, `_block`, `_starts` (the guessed state at its first own row, null
    where there is nothing to guess) and `_ends`, the last two on one row of the block.  A column `_seed`, where there is one,
    holds the state to start from, and there are no rows before the block's own then.
    """
    done = rows.groupBy("_block").applyInPandas(run, schema)
    if rows.agg(F.max("_block")).first()[0]:
        rows, done = stored(rows, "blocks"), stored(done, "settled")
        while True:
            states = done.where("_ends is not null").select("_block", "_starts", "_ends")
            before = states.select((F.col("_block") + 1).alias("_block"), F.col("_ends").alias("_seed"))
            wrong = stored(states.join(before, "_block").where("_starts is not null and _starts != _seed").select("_block", "_seed"), "wrong")
            if not wrong.limit(1).count():
                break
            again = rows.where(F.floor(F.col("_place") / block) == F.col("_block")).join(wrong, "_block").groupBy("_block").applyInPandas(run, schema)
            done = stored(done.join(wrong, "_block", "left_anti").select(*done.columns).unionByName(again), "settled")
    return done.where("_place is not null")


def with_drift(rows: DataFrame, s: Settings = SETTINGS, warm: str | None = None) -> DataFrame:
    """Adds `drifted` to rows with a `_place`.

    A monitor's window reaches as far back as nothing drifts, so a ticker is followed in one task; rows stream through it, and
    what is kept of them is logarithmic.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ticker, monitor = object(), None
        for pdf in batches:
            out = []
            for row in pdf[["ticker", *FEATURES, *([warm] if warm else [])]].to_dict("records"):
                if row["ticker"] != ticker:
                    ticker, monitor = row["ticker"], DriftMonitor(s.drift_delta)
                learns = not (warm and row[warm])
                out.append(monitor.update({f: 0.0 if row[f] is None or row[f] != row[f] else row[f] for f in FEATURES}) if learns else [])
            yield pdf.assign(drifted=out)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(n, "ticker").sortWithinPartitions("ticker", "_place").mapInPandas(run, f"{schema}, drifted array<string>")


def replay(features: DataFrame, order: list[str], s: Settings = SETTINGS, autoencoder: Autoencoder | None = None, make_cep: Callable[[], CepDetector] | None = None, warm: str | None = None, drift: bool = True, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Every row scored, then learned, in the order of its ticker.  Rows where the column `warm` is true only warm up and don't come out.

    A long ticker is many blocks, each a task's group of a bounded size.  A block guesses the state that it starts from by
    running through the `halo` rows before it; averages forget and matches expire, so the guess is nearly always the state
    in which the block before it ended, to the last bit.  Where it isn't, the block is run again from that state, until all
    agree: the result is that of one pass in order, whatever the guesses.  `drifted` (empty unless `drift`) can't be guessed
    so; see `with_drift`.
    """
    names = features.columns
    added = [c.split()[0] for c in REPLAY.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        own = (pdf["_place"] // block == pdf["_block"]).tolist()
        columns = {f: pdf[f].tolist() for f in FEATURES if f in pdf}
        warming, tickers = pdf[warm].tolist() if warm else [False] * len(pdf), pdf["ticker"].tolist()
        seed = pdf["_seed"].iloc[0] if "_seed" in pdf else None
        fresh = lambda: Key(s, autoencoder, make_cep, False)
        key, ticker, started, out, kept = None, object(), None, [], []
        for i, ticker_now in enumerate(tickers):
            row = {f: (0.0 if v[i] is None or v[i] != v[i] else v[i]) for f, v in columns.items()}
            if ticker_now != ticker:
                key, ticker = fresh(), ticker_now
                if seed is not None and not i:
                    key, started = fresh().resume(seed), seed
            elif own[i] and not own[i - 1]:
                started = key.state()
            if warming[i]:
                key.warm(row)
            elif own[i]:
                kept.append(i)
                out.append(key.step(row))
            else:
                key.step(row)
        scored = pd.DataFrame(out, columns=added)
        rows = pd.concat([pdf.loc[kept].reset_index(drop=True), scored], axis=1)
        rows["drifted"] = pdf.loc[kept, "_drifted"].tolist() if "_drifted" in pdf else rows["drifted"]
        rows = rows.assign(_starts=None, _ends=None)[[*names, *added, "_place", "_block", "_starts", "_ends"]]
        if not kept:  # a row without a place carries the states of a block that only warms up
            rows = pd.DataFrame([[None] * len(rows.columns)], columns=rows.columns).assign(_block=pdf["_block"].iloc[0])
        rows["_starts"], rows["_ends"] = ([None] * (len(rows) - 1) + [state] for state in (started, key.state()))
        return rows

    rows = blocked(features, ["ticker", *order], block, max(1, halo))  # a block must see whether its ticker goes on
    if drift:
        own = with_drift(rows.where(F.floor(F.col("_place") / block) == F.col("_block")), s, warm).select("_place", F.col("drifted").alias("_drifted"))
        rows = rows.join(own, "_place", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields)
    schema = f"{schema}, {REPLAY}, _place long, _block long, _starts binary, _ends binary"
    return settled(rows, run, schema, block).select(*names, *added)


def with_hst(features: DataFrame, order: list[str], s: Settings = SETTINGS, warm: str | None = None, windows: int = 64) -> DataFrame:
    """Adds `hst`.  The trees know no tickers: one model learns all rows in one order.

    A score depends on the last full window only.  So blocks of so many windows are independent tasks, each of which learns
    the window before its first row too; scores are those of one model that goes through all rows.  Rows where the column
    `warm` is true are learned and score 0.
    """
    size = s.hst_window * windows
    block = F.floor(F.col("_place") / size)
    ends = F.col("_place") % size >= size - s.hst_window
    rows = positions(features, order, "_place").withColumn("_block", F.explode(F.when(ends, F.array(block, block + 1)).otherwise(F.array(block))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        scores = HalfSpaceTrees(s.hst_trees, s.hst_height, s.hst_window, s.seed).replay(pdf[list(FEATURES)].astype(float).fillna(0.0).to_numpy())
        if warm:
            scores[pdf[warm].to_numpy(bool)] = 0.0
        return pdf.assign(hst=scores)[pdf["_place"] >= pdf["_block"] * size].drop(columns=["_place", "_block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields)
    names = features.columns
    return rows.groupBy("_block").applyInPandas(lambda pdf: run(pdf)[[*names, "hst"]], f"{schema}, hst double")


def with_iforest(features: DataFrame, model: IsolationForest) -> DataFrame:
    """Adds `isolation_forest`: rows don't depend on each other, so whole batches are scored where they are."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(isolation_forest=shared.value.scores(pdf[list(FEATURES)].fillna(0).to_numpy(float)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields)
    return features.mapInPandas(run, f"{schema}, isolation_forest double")


class Together:
    """Several detectors that score and learn a row one after the other, for timing them as one."""

    def __init__(self, *detectors: Detector) -> None:
        self.detectors = detectors

    def score(self, row: dict) -> list[float]:
        return [d.score(row) for d in self.detectors]

    def update(self, row: dict) -> None:
        for d in self.detectors:
            d.update(row)


def timed_replay(features: DataFrame, order: list[str], s: Settings = SETTINGS, make: Callable[[], CepDetector | Together] | None = None) -> DataFrame:
    """ticker, latency_ms of every row's score, by the CEP detector or by what `make` makes for each ticker; learning is not timed."""
    from time import perf_counter

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, scorer, ticker = [], None, object()
        for row in pdf.sort_values("_place").to_dict("records"):
            if row["ticker"] != ticker:
                ticker, scorer = row["ticker"], make() if make else CepDetector(s)
            began = perf_counter()
            scorer.score(row)
            took = (perf_counter() - began) * 1000
            if row["_place"] // BLOCK == row["_block"]:
                out.append((ticker, took))
            scorer.update(row)
        return pd.DataFrame(out, columns=["ticker", "latency_ms"])

    return blocked(features, ["ticker", *order]).groupBy("_block").applyInPandas(run, "ticker string, latency_ms double")
