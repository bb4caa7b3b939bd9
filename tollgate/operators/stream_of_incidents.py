"""From candidates to decisions and to the events of the incident fold: every candidate at every time it is looked at, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialized
from .cohorts import analyze_candidates
from .decide import decide_views
from .detect import as_of_view, concurrent_counts, decidable
from .incidents import EVENT

#: Looks after detection while the episode is open, and the most there are with the one at recovery.
CHECKPOINTS, MOST = (21_600, 86_400), 3


def checkpoints(cand: DataFrame, world_end: int, after: tuple[int, ...] = CHECKPOINTS, most: int = MOST) -> DataFrame:
    """The candidate's columns with t and nth (0 at detection, else the checkpoint): +6 h and +24 h while open, and recovery."""
    end = F.coalesce("recovered_at", F.lit(world_end))
    later = F.filter(F.transform(F.array(*map(F.lit, after)), lambda s: F.col("detected_at") + s), lambda t: t < end)
    times = F.slice(F.array_sort(F.array_distinct(F.concat(later, F.array_compact(F.array("recovered_at"))))), 1, most)
    return cand.select("*", F.posexplode(F.concat(F.array("detected_at"), times)).alias("nth", "t"))


def decide_all(norm: DataFrame, cand: DataFrame, world_start: int, world_end: int, assessed: DataFrame | None = None, source: str = "policy", looks: bool = False) -> DataFrame:
    """Decisions (decide_views) at first look of every decidable candidate, and with ``looks`` at every checkpoint too, each
    analysed on its window up to then, all in one job.

    Adds anomaly_id, nth, metric, direction, start, window_end, scope, locus (arrays), change_type, lost (the impact) and
    evidence_ids. A view is named by candidate and time, so views of one candidate don't meet.
    """
    live = materialized(decidable(cand), "decidable")
    seen = checkpoints(live, world_end) if looks else live.select("*", F.lit(0).alias("nth"), F.col("detected_at").alias("t"))
    views = as_of_view(seen).withColumns({"window_end": F.col("t"), "as_of": F.col("t"), "candidate_id": F.concat_ws("@", "anomaly_id", F.col("t").cast("string"), F.col("nth").cast("string"))})
    views = materialized(views, "views")
    found = materialized(analyze_candidates(norm, views.drop("anomaly_id").withColumnRenamed("candidate_id", "anomaly_id"), world_start, world_end), "view-analyses")
    near = concurrent_counts(live, views.select(F.col("candidate_id").alias("id"), "anomaly_id", F.col("window_start").alias("since"), F.col("t").alias("at")))
    decided = decide_views(views, found, near, assessed, source)
    pairs = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    # without an analysis the scope is the place
    place = F.array_distinct(F.concat(pairs(F.col("scope")), pairs(F.col("locus"))))
    own = views.select("candidate_id", "anomaly_id", "nth", "metric", F.col("window_start").alias("start"), "window_end", "scope", "evidence_ids", "recovered_at")
    own = own.join(found.select("candidate_id", "locus", F.col("label").alias("found_label"), F.col("impact").alias("lost")), "candidate_id", "left")
    own = own.select("candidate_id", "anomaly_id", "nth", "metric", "start", "window_end", pairs(F.col("scope")).alias("scope"), place.alias("locus"), "lost", "evidence_ids")
    return decided.join(own, "candidate_id")


def incident_event_stream(decided: DataFrame, cand: DataFrame, run_id: str = "run", hysteresis: int = 0) -> DataFrame:
    """The fold's events: each decision as detected or checkpoint, each recovery and its check after the quiet time."""
    names = {x.split()[0]: x.split(maxsplit=1)[1] for x in EVENT.split(", ")}
    have = {"run_id": F.lit(run_id), "time": F.col("as_of"), "kind": F.when(F.col("nth") == 0, "detected").otherwise("checkpoint"), "candidate_id": F.col("anomaly_id"), "parent": F.array().cast("array<string>")}
    kept = ("metric", "direction", "start", "locus", "route", "verified", "decision_id")
    looks = decided.select(*(have.get(n, F.col(n) if n in kept else F.lit(None)).cast(t).alias(n) for n, t in names.items()))
    ended = decidable(cand).where("recovered_at is not null").select(F.col("anomaly_id").alias("candidate_id"), F.inline(F.array(F.struct(F.lit("recovered").alias("kind"), F.col("recovered_at").alias("time")), F.struct(F.lit("recovery_check").alias("kind"), (F.col("recovered_at") + hysteresis).alias("time")))))
    ended = ended.withColumns({"run_id": F.lit(run_id), "verified": F.lit(False)})
    return looks.unionByName(ended.select(*((F.col(n) if n in ended.columns else F.lit(None)).cast(t).alias(n) for n, t in names.items())))
