"""Presence of claims over a stream of captures, which may come in any order and more than once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.claims import presence_of

CLAIMS = T.StructType([T.StructField("scope", T.LongType()), T.StructField("claim", T.LongType()), T.StructField("n", T.LongType()), T.StructField("last_seen", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("seen_complete", T.BooleanType()), T.StructField("weak", T.BooleanType())])
SCOPES = T.StructType([T.StructField("scope", T.LongType()), T.StructField("n", T.LongType()), T.StructField("latest", T.LongType()), T.StructField("n_latest", T.LongType()), T.StructField("all_complete", T.BooleanType()), T.StructField("late", T.ArrayType(T.LongType()))])


def _frames(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(rows, ignore_index=True)


class ClaimState(StatefulProcessor):
    """A claim of a scope: the last instant that listed it, which captures did then, whether one was complete, whether a key was weak.
    All are maxima or unions, so neither order nor repetition matters; the state is as large as one instant's captures."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("claim", "n long, last_seen long, caps array<long>, seen_complete boolean, weak boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = _frames(rows)
        n, last, caps, complete, weak = self.state.get() if self.state.exists() else (0, None, [], False, False)
        top = int(x["instant"].max())
        if last is None or top > last:
            last, caps, complete = top, [], False
        now = x[x["instant"] == last]
        caps = sorted({*caps, *now["cap"].astype(int).tolist()})
        complete, weak = bool(complete or now["complete"].any()), bool(weak or x["weak"].any())
        self.state.update((n + 1, last, caps, complete, weak))
        yield pd.DataFrame([(key[0], key[1], n + 1, last, len(caps), complete, weak)], columns=CLAIMS.names)

    def close(self) -> None:
        pass


class ScopeState(StatefulProcessor):
    """A scope: its last instant, the captures of it, whether all are complete. Captures before it when they come are late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scope", "n long, latest long, caps array<long>, all_complete boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = _frames(rows)
        n, latest, caps, complete = self.state.get() if self.state.exists() else (0, None, [], True)
        late = [] if latest is None else sorted(set(x.loc[x["instant"] < latest, "cap"].astype(int)))
        top = int(x["instant"].max())
        if latest is None or top > latest:
            latest, caps, complete = top, [], True
        now = x[x["instant"] == latest]
        caps, complete = sorted({*caps, *now["cap"].astype(int).tolist()}), bool(complete and now["complete"].all())
        self.state.update((n + 1, latest, caps, complete))
        yield pd.DataFrame([(key[0], n + 1, latest, len(caps), complete, late)], columns=SCOPES.names)

    def close(self) -> None:
        pass


def claim_updates(seen: DataFrame) -> DataFrame:
    """Rows CLAIMS, one for each claim that a batch touches; n counts a claim's updates. seen: scope, claim, cap, instant (microseconds),
    complete, weak. Claims are keyed one by one, so a scope with most of them is spread."""
    seen.sparkSession.streams  # noqa: B018  (a session without streams yet has no coordinator of state)
    return seen.select("scope", "claim", "cap", "instant", "complete", "weak").groupBy("scope", "claim").transformWithStateInPandas(ClaimState(), CLAIMS, "append", "none")


def scope_updates(captures: DataFrame) -> DataFrame:
    """Rows SCOPES, one for each scope that a batch touches. captures: scope, cap, instant, complete."""
    captures.sparkSession.streams  # noqa: B018
    return captures.select("scope", "cap", "instant", "complete").groupBy("scope").transformWithStateInPandas(ScopeState(), SCOPES, "append", "none")


def presence(claims: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, claim, presence) from all updates so far."""
    last = lambda df, keys, schema: df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in keys]), "n").alias("e")).select(*keys, "e.*").drop("n")
    x = last(claims, ["scope", "claim"], CLAIMS).join(last(scopes, ["scope"], SCOPES), "scope")
    return x.select("scope", "claim", presence_of(F.col("last_seen"), F.col("hits"), F.col("seen_complete"), F.col("weak")).alias("presence"))
