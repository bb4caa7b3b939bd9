"""The incident fold on a stream: the groups of a run as its state, events in order within a batch and over batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.correlate import GAP
from ..operators.incidents import _OUT, EVENT, Columns, Fold, ready, rows_of

_ORDER = ["time", "nth", "by_id", "command", "target_id", "reason"]
#: How long before its detection a candidate may have begun; groups further back are out of every later one's reach.
HORIZON = 40 * 86_400
CHUNK = 5_000
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


class _Run(StatefulProcessor):
    def __init__(self, rules: dict, horizon: int, schema: pa.Schema):
        self.rules, self.horizon, self.schema = rules, horizon, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fold", "fold binary, time bigint, nth int, by_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        fold, last = Fold(**self.rules), tuple(state[1:]) if state else (-1, -1, "")
        if state:
            fold.resume(pickle.loads(state[0]))
        # a run's new events stay in columns; only CHUNK of them at a time are Python objects
        new = pa.concat_tables(pa.Table.from_pandas(chunk, self.schema, preserve_index=False, safe=False) for chunk in rows)
        keys = pa.table({c: pc.fill_null(new.column(c), "") if c in _ORDER[2:] else new.column(c) for c in _ORDER})
        order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in _ORDER])
        del keys
        out, columns = [], Columns()
        for first in range(0, len(order), CHUNK):
            for e in columns.events(new.take(order.slice(first, CHUNK))):
                at = (e["time"], e["nth"], e["by_id"] or "")
                e["ahead"] = at[0] - self.horizon
                if at < last:
                    fold.out = []
                    fold._tell("rejected", e, incident_id=e["incident_id"], candidate_id=e["candidate_id"], actor=e["actor"], kind=e["kind"], reason="late")
                    out += fold.out
                    continue
                last = at
                out += fold.apply(e)
            if out:
                yield rows_of(out).to_pandas(types_mapper={pa.int32(): pd.Int32Dtype()}.get)
                out = []
        self.held.update((pickle.dumps(fold.state()), *last))

    def close(self) -> None:
        pass


def stream_incidents(events: DataFrame, gap: int = GAP, hysteresis: int = 0, mode: str = "pairs", ingestion_anchors: bool = False, renewal_with_approval: bool = False, parent_locus: bool = False, horizon: int = HORIZON) -> DataFrame:
    """The rows of fold_incidents of a stream of fold events (columns of EVENT), a run as one island.

    Events come in order over the batches, in any order within one; an event before the last one of its run changes nothing
    and gives a rejected row that says late. A candidate must not begin more than ``horizon`` seconds before it is seen.
    Needs the RocksDB state store; a run's state is its groups and the last look at each candidate.
    """
    own = [x.split()[0] for x in EVENT.split(", ")]
    named = events.select(*own).withColumn("run_id", F.coalesce("run_id", F.lit(""))).withColumn("island", F.lit(""))
    rules = {"gap": gap, "hysteresis": hysteresis, "mode": mode, "ingestion_anchors": ingestion_anchors, "parent_locus": parent_locus}
    prepared = ready(named, renewal_with_approval)
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in prepared.dtypes])
    return prepared.groupBy("run_id").transformWithStateInPandas(statefulProcessor=_Run(rules, horizon, schema), outputStructType=_OUT, outputMode="Append", timeMode="None")
