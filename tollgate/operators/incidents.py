"""Incidents: an ordered fold of candidates, checkpoints, recoveries and commands into groups that open, grow and close.

A run's candidates are cut into islands, sets of candidates that can never meet in one group, and every island is folded
on its own: rows are dealt by island, sorted by time inside the task and streamed through the fold, whose state is the
island's groups and nothing else. A group that no later candidate can reach any more is no longer looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.graph import components
from ..functions.storage import materialized
from .context import TRANSITIONS
from .correlate import DAY, GAP, GROUPS, MORE_STEPS, STEPS, chains, metric_groups
from .detect import stable_id

#: Kinds of fold events in the order in which those of one moment count.
KINDS = ("detected", "checkpoint", "recovered", "recovery_check", "human", "impact", "investigation")
TERMINAL = ("RESOLVED", "DISMISSED")
COMMANDS = {"acknowledge": "ACKNOWLEDGED", "escalate": "ESCALATED", "resolve": "RESOLVED", "dismiss": "DISMISSED"}
#: What the metric of an incident's first member is called in its title.
FAMILY = {
    "authorization_rate": "approval", "checkout_conversion_rate": "conversion", "renewal_success_rate": "renewal", "dunning_recovery_rate": "dunning", "refund_count": "refunds", "refund_rate": "refunds",
    "duplicate_charge_rate": "duplicates", "attempt_volume": "volume", "fraud_flag_rate": "fraud", "subscription_cancellation_rate": "cancellations", "late_arrival_share": "ingestion",
}
FOREVER = 1 << 40
MOST_VERDICTS = 1 << 16

#: Groups that ended longer ago than the gap and this are out of sight of looks that began since.
RECENT = DAY

EVENT = "run_id string, time bigint, kind string, candidate_id string, incident_id string, target_id string, actor string, command string, reason string, metric string, direction string, start bigint, locus array<string>, parent array<string>, route string, verified boolean, decision_id string"
_OUT = "run_id string, island string, step bigint, part string, incident_id string, candidate_id string, group_id string, time bigint, cause_kind int, cause_id string, seq int, status string, actor string, reason string, kind string, evidence string, decision_id string, promoted_to string"


def incident_id(candidate: Column) -> Column:
    """The id of the incident that a candidate would open."""
    return stable_id("inc_", candidate)


def digest_id(candidate: Column) -> Column:
    """The id of the digest group that a candidate would open."""
    return stable_id("dg_", candidate)


def chains_of(rows: DataFrame, gap: int = GAP) -> DataFrame:
    """Adds head: where the chain begins that a row belongs to among those of its (run_id, grp), rows (s, e) within gap being linked.

    Two levels, so that no window holds a whole run: first inside spans of thirty days, then over the spans' maxima.
    """
    rows = rows.withColumn("span", F.floor(F.col("s") / (30 * DAY)))
    whole, before = W.partitionBy("run_id", "grp").orderBy("span"), W.partitionBy("run_id", "grp", "span").orderBy("s", "id")
    ends = rows.groupBy("run_id", "grp", "span").agg(F.max("e").alias("most"))
    ends = ends.select("run_id", "grp", "span", F.max("most").over(whole.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    far = F.greatest(F.max("e").over(before.rowsBetween(W.unboundedPreceding, -1)), "carried")
    rows = rows.join(ends, ["run_id", "grp", "span"]).withColumn("far", far)
    rows = rows.withColumn("opens", F.when(F.col("far").isNull() | (F.col("s") > F.col("far") + gap), F.col("s")))
    last = rows.groupBy("run_id", "grp", "span").agg(F.max("opens").alias("most"))
    last = last.select("run_id", "grp", "span", F.max("most").over(whole.rowsBetween(W.unboundedPreceding, -1)).alias("carried_head"))
    head = F.coalesce(F.max("opens").over(before.rowsBetween(W.unboundedPreceding, 0)), "carried_head")
    return rows.join(last, ["run_id", "grp", "span"]).withColumn("head", head).drop("span", "carried", "far", "opens", "carried_head")


def first_chains(candidates: DataFrame, gap: int = GAP) -> DataFrame:
    """run_id, id, s, e, grps and nodes (its chains) of every candidate; of candidates as islands() reads them."""
    names = sorted({g for *_, g in GROUPS})
    every = F.array_contains("groups", "ingestion") | (F.size("groups") == 0)
    grps = F.when(every, F.array(*map(F.lit, names))).otherwise(F.col("groups"))
    known = candidates.select("run_id", F.col("candidate_id").alias("id"), F.col("start").alias("s"), F.greatest("start", F.coalesce("until", F.lit(FOREVER))).alias("e"), grps.alias("grps"))
    return _chained(materialized(known, "candidates"), gap)


def _chained(known: DataFrame, gap: int) -> DataFrame:
    chained = chains_of(known.withColumn("grp", F.explode("grps")), gap).withColumn("node", F.concat_ws("|", "run_id", "grp", F.col("head").cast("string")))
    # a set of at most as many chains as there are metric groups
    return materialized(chained.groupBy("run_id", "id").agg(F.first("s").alias("s"), F.first("e").alias("e"), F.first("grps").alias("grps"), F.array_sort(F.collect_set("node")).alias("nodes")), "chains")


def islands(candidates: DataFrame, gap: int = GAP, merges: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    """run_id, candidate_id, island: candidates of different islands can never meet in one group.

    candidates: run_id, candidate_id, start, until (null: open to the end) and groups (of its metric). merges: pairs of
    candidates (run_id, a, b) whose groups someone joined. Candidates of one metric group that follow each other within
    the gap are a chain, late data and metrics without a group stand in every chain; what shares a candidate or a merge
    is one island. If a group may hold several metric groups (``mixed``, or merges), an island reaches as far as all its
    members do, so chains are drawn anew over islands until none grow.
    """
    return islands_of(first_chains(candidates, gap), gap, merges, mixed)


def islands_of(chained: DataFrame, gap: int = GAP, merges: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    """islands() from the first chains."""
    of = chained.select("run_id", F.col("id").alias("candidate_id"), F.col("id").alias("island"))
    while True:
        edges = chained.where("size(nodes) > 1").select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")).where("a != b")
        if merges is not None:
            at = of.join(chained.select("run_id", F.col("id").alias("island"), F.col("nodes")[0].alias("node")), ["run_id", "island"])
            both = merges.join(at.select("run_id", F.col("candidate_id").alias("a"), F.col("node").alias("na")), ["run_id", "a"]).join(at.select("run_id", F.col("candidate_id").alias("b"), F.col("node").alias("nb")), ["run_id", "b"])
            edges = edges.unionByName(both.where("na != nb").select(F.col("na").alias("a"), F.col("nb").alias("b")))
        new = chained.withColumn("node", F.col("nodes")[0]).join(components(edges), "node", "left").select("run_id", "id", F.coalesce("comp", "node").alias("comp"), "s", "e", "grps")
        new = materialized(new, "islands")
        of = materialized(of.join(new.select("run_id", F.col("id").alias("island"), "comp"), ["run_id", "island"]).select("run_id", "candidate_id", F.col("comp").alias("island")), "islands")
        grown = new.groupBy("run_id", F.col("comp").alias("id")).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_distinct(F.flatten(F.collect_set("grps"))).alias("grps"), F.count("*").alias("held"))
        known = materialized(grown, "islands")
        if not (mixed or merges is not None) or known.where("held > 1 and size(grps) > 1").isEmpty():
            return of
        chained = _chained(known.drop("held"), gap)


def whole_islands(chained: DataFrame, merges: DataFrame, gap: int = GAP) -> DataFrame:
    """islands() whatever the metric groups, in one pass: what someone joined is a stretch of time with all that lies in it.

    Coarser than islands_of, which draws chains anew and joins them until none grow.
    """
    rows = chained.select("run_id", "id", "s", "e")
    at = lambda x: rows.select("run_id", F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("e").alias(f"e{x}"))
    joined = merges.join(at("a"), ["run_id", "a"]).join(at("b"), ["run_id", "b"])
    joined = joined.select("run_id", F.lit(None).cast("string").alias("id"), F.least("sa", "sb").alias("s"), F.greatest("ea", "eb").alias("e"))
    found = chains_of(rows.unionByName(joined).withColumn("grp", F.lit("")), gap).where("id is not null")
    return found.select("run_id", F.col("id").alias("candidate_id"), F.concat_ws("|", "run_id", F.lit(""), F.col("head").cast("string")).alias("island"))


class Look(NamedTuple):
    """What is kept of a look."""

    candidate: str
    groups: frozenset
    locus: frozenset
    parent: frozenset
    start: int
    decision: str | None


def _kind(look: Look) -> tuple:
    """All that a verdict reads of a look."""
    return look[1:4]


def _named(prefix: str, candidate: str) -> str:
    """What stable_id says of a candidate."""
    return prefix + hashlib.sha256(candidate.encode()).hexdigest()[:16]


_JSON = json.JSONEncoder(sort_keys=True).encode


class _Group:
    """Members by the order in which they came; what is asked of all of them is kept up as they change, never worked out over them."""

    KEPT = ("gid", "incident", "at", "members", "starts", "status", "seq", "promoted")
    __slots__ = (*KEPT, "since", "open", "last", "place", "kinds", "seen")

    def __init__(self, gid: str, incident: bool, at: int):
        self.gid, self.incident, self.at = gid, incident, at
        self.members: dict[str, Look] = {}
        self.starts: dict[str, int] = {}
        self.status, self.seq, self.promoted = "DETECTED", 0, False
        # follows from the members: the earliest start, how many are open, the last recovery, places, and places by kind
        self.since, self.open, self.last = FOREVER, 0, -FOREVER
        # the last two are not kept while the group is out of reach
        self.place: dict[str, int] | None = {}
        self.kinds: dict[tuple, list[tuple[int, str]]] | None = {}
        self.seen: list[Look] | None = None

    def put(self, c: str, look: Look) -> None:
        """Adds a member, or what is known of it now, at the place it has."""
        old, kind = self.members.get(c), _kind(look)
        self.members[c] = look
        if self.kinds is None:
            return
        place = self.place.setdefault(c, len(self.place))
        if old is None or _kind(old) != kind:
            heapq.heappush(self.kinds.setdefault(kind, []), (place, c))
        self.seen = None

    def rest(self) -> None:
        """Out of reach."""
        self.place = self.kinds = self.seen = None

    def wake(self) -> None:
        """Within reach again: places are the members' order."""
        if self.kinds is None:
            self.place, self.kinds = {}, {}
            for place, (c, look) in enumerate(self.members.items()):
                self.place[c] = place
                self.kinds.setdefault(_kind(look), []).append((place, c))

    def start(self, c: str, at: int) -> None:
        """When a member began."""
        old = self.starts.get(c, at)
        self.starts[c] = at
        self.since = min(self.since, at) if old == at else min(self.starts.values())

    def firsts(self) -> list[Look]:
        """The first member of each kind, in order: the others of its kind get the same verdict later."""
        if self.seen is None:
            for kind, places in [*self.kinds.items()]:
                while places and _kind(self.members[places[0][1]]) != kind:  # it changed since
                    heapq.heappop(places)
                if not places:
                    del self.kinds[kind]
            self.seen = [self.members[c] for _, c in sorted(x[0] for x in self.kinds.values())]
        return self.seen

    def over(self) -> bool:
        return self.promoted or (self.incident and self.status in TERMINAL)


class Fold:
    """The groups of one island, and what becomes of them event by event."""

    def __init__(self, gap: int, hysteresis: int, mode: str, ingestion_anchors: bool, parent_locus: bool):
        self.gap, self.hysteresis, self.mode = gap, hysteresis, mode
        self.ingestion_anchors, self.parent_locus = ingestion_anchors, parent_locus
        self.steps = set(chains(STEPS + (MORE_STEPS if mode == "chains_plus" else ())))
        self.moves = {(a, b): {x for p, q, x in TRANSITIONS if (p, q) == (a, b)} for a, b, _ in TRANSITIONS}
        self.groups: dict[str, _Group] = {}
        # groups that a look may reach, and those of them that only a look of long ago can
        self.near: dict[str, _Group] = {}
        self.far: dict[str, _Group] = {}
        self.home: dict[str, _Group] = {}
        self.looks: dict[str, Look] = {}
        self.recovered: dict[str, int] = {}
        self.through: dict[str, str] = {}
        self.inside: dict[str, list[_Group]] = {}
        self.known: dict[tuple, tuple[str, list[str]] | None] = {}
        self.out: list[dict] = []
        self.step, self.ahead, self.tidied = 0, -FOREVER, -FOREVER

    def state(self) -> dict:
        """What has happened so far as plain containers, groups by their ids."""
        kept = {c: getattr(self, c) for c in ("recovered", "through", "step", "ahead")} | {"looks": {c: tuple(look) for c, look in self.looks.items()}}
        # most members are known by their last look
        members = lambda g: {c: None if look is self.looks.get(c) else tuple(look) for c, look in g.members.items()}
        groups = {gid: {c: getattr(g, c) for c in _Group.KEPT} | {"members": members(g)} for gid, g in self.groups.items()}
        return kept | {"groups": groups, "near": [*self.near, *self.far], "home": {c: g.gid for c, g in self.home.items()}}

    def resume(self, state: dict) -> None:
        """Goes on from a state."""
        for c in ("recovered", "through", "step", "ahead"):
            setattr(self, c, state[c])
        self.looks = {c: Look(*look) for c, look in state["looks"].items()}
        for gid, columns in state["groups"].items():
            g = self.groups[gid] = _Group(gid, columns["incident"], columns["at"])
            for c, look in columns["members"].items():
                self._put(g, c, Look(*look) if look else self.looks[c], columns["starts"][c])
            g.status, g.seq, g.promoted = columns["status"], columns["seq"], columns["promoted"]
        self.near = {gid: self.groups[gid] for gid in state["near"]}
        for gid in self.groups.keys() - self.near.keys():
            self.groups[gid].rest()
        self.home = {c: self.groups[gid] for c, gid in state["home"].items()}

    # rules

    def _nests(self, a: frozenset, b: frozenset) -> bool:
        """Whether two loci with some pairs each are equal or one lies in the other by an approved step."""
        if not a or not b:
            return False
        small, large = sorted((a, b), key=len)
        if a == b or not small < large:
            return a == b
        dims = lambda x: ",".join(sorted(v.split("=")[0] for v in x))
        return self.mode == "pairs" or f"{dims(small)}>{dims(large)}" in self.steps

    def _verdict(self, look: Look, other: Look) -> tuple[str, list[str]] | None:
        """The verdict on two looks, worked out once for their kinds."""
        both = _kind(look), _kind(other)
        if both not in self.known:
            if len(self.known) > MOST_VERDICTS:
                self.known.clear()
            self.known[both] = self._relation(look, other)
        return self.known[both]

    def _relation(self, look: Look, other: Look) -> tuple[str, list[str]] | None:
        """How a look relates to a member: specific by its own or a parent's locus, global or related, with the groups shared."""
        mine, theirs = look.groups, other.groups
        if theirs == {"ingestion"} and "ingestion" not in mine and not self.ingestion_anchors:
            return None
        late = "ingestion" in mine or "ingestion" in theirs
        shared = sorted((mine | theirs) if late else (mine & theirs))
        if not shared:
            return None
        if self._nests(look.locus, other.locus):
            return "nested", shared
        if self.parent_locus and any(self._nests(getattr(look, x), getattr(other, y)) for x, y in (("locus", "parent"), ("parent", "locus"), ("parent", "parent"))):
            return "parent", shared
        return "not_nested" if look.locus else "global", shared

    def _span(self, g: _Group, t: int) -> tuple[int, int]:
        return g.since, t if g.open or g.last > t else g.last

    def _within(self, look: Look, t: int, incident: bool) -> list[tuple[int, str, _Group]]:
        """The groups that a look meets in time, the oldest first."""
        first, last, found = look.start - self.gap, t + self.gap, []
        for groups in (self.near, self.far) if look.start < t - RECENT else (self.near,):
            for g in groups.values():
                if g.incident == incident and g.since <= last and (t if g.open or g.last > t else g.last) >= first and not g.over():
                    found.append((g.at, g.gid, g))
        return sorted(found)

    def _decide(self, look: Look, t: int, incident: bool) -> tuple[_Group | None, list[_Group], dict]:
        """The group to join, or those that are only related, and why."""
        specific, loose, related = None, [], []
        for *_, g in self._within(look, t, incident):
            s, e = self._span(g, t)
            when, first = "overlap" if look.start < e and s < t else "gap", None
            for other in g.firsts():
                verdict = self._verdict(look, other)
                if verdict and (first is None or verdict[0] in ("nested", "parent")):
                    first = {"time": when, "cohort": verdict[0], "group": verdict[1], "member": other.candidate}
                    if verdict[0] in ("nested", "parent"):
                        specific = (g, first)
                        break
            if specific:
                break
            if first:
                (loose if first["cohort"] == "global" else related).append((g, first))
        if specific:
            return specific[0], [], specific[1]
        if len(loose) == 1:
            return loose[0][0], [], loose[0][1] | {"cohort": "global_unambiguous"}
        if loose:
            return None, [g for g, _ in loose], {"cohort": "global_ambiguous"}
        return None, [g for g, _ in related], {"cohort": "not_nested" if related else "none"}

    # rows

    def _tell(self, part: str, e: dict, **columns) -> None:
        self.step += 1
        key = {"run_id": e["run_id"], "island": e["island"], "step": self.step, "part": part, "time": e["time"], "cause_kind": e["nth"], "cause_id": e["by_id"]}
        self.out.append(_NOTHING | key | columns)

    def _row(self, e: dict, g: _Group, actor: str, reason: str) -> None:
        g.seq += 1
        self._tell("event", e, incident_id=g.gid, seq=g.seq, status=g.status, actor=actor, reason=reason)

    def _move(self, e: dict, g: _Group, status: str, actor: str, reason: str) -> None:
        g.status = status
        self._row(e, g, actor, reason)

    def _put(self, g: _Group, c: str, look: Look, start: int) -> None:
        if c not in g.members:
            self.inside.setdefault(c, []).append(g)
            if c in self.recovered:
                g.last = max(g.last, self.recovered[c])
            else:
                g.open += 1
        g.put(c, look)
        g.start(c, start)

    def _link(self, e: dict, g: _Group, look: Look, kind: str, evidence: dict) -> None:
        c = look.candidate
        self._reach(g)
        self._put(g, c, look, look.start)
        self.home[c] = g
        if evidence.get("member", c) != c:
            self.through[c] = evidence["member"]
        if g.incident:
            self._tell("link", e, incident_id=g.gid, candidate_id=c, kind=kind, evidence=_JSON(evidence))
        else:
            self._tell("digest", e, group_id=g.gid, candidate_id=c, decision_id=look.decision)

    def _open(self, e: dict, seed: Look, incident: bool) -> _Group:
        gid = _named("inc_" if incident else "dg_", seed.candidate)
        self.groups[gid] = self.near[gid] = g = _Group(gid, incident, e["time"])
        return g

    def _promote(self, e: dict, d: _Group, look: Look | None, evidence: dict) -> None:
        order = sorted(d.members, key=lambda c: (d.starts[c], c))
        g = self._open(e, self.looks[order[0]], True)
        for c in order:
            self._link(e, g, self.looks[c], "promote", {"digest_group": d.gid})
            self._tell("digest", e, group_id=d.gid, candidate_id=c, decision_id=self.looks[c].decision, promoted_to=g.gid)
        d.promoted = True
        if look and look.candidate not in g.members:
            self._link(e, g, look, "join", evidence)
        self._row(e, g, "policy", "digest_promoted")

    # events

    def _look(self, e: dict) -> None:
        c = e["candidate_id"]
        look = self.looks[c] = Look(c, e["groups"], e["locus"], e["parent"], e["start"], e["decision_id"])
        home = self.home.get(c)
        urgent = e["route"] == "INCIDENT"
        if home:
            # a finer locus counts unless it leaves the member through which this one came
            anchor = home.members.get(self.through.get(c, ""))
            if anchor is None or self._nests(look.locus, anchor.locus):
                home.put(c, look)
            if home.incident and e["verified"]:
                self._row(e, home, "policy", "checkpoint_update")
            elif not home.incident and urgent:
                self._promote(e, home, None, {})
            return
        if e["route"] == "IGNORE":
            return
        g, related, why = self._decide(look, e["time"], True)
        if g:
            self._link(e, g, look, "join" if urgent else "support", why)
            if g.status == "RECOVERING":
                self._move(e, g, "INVESTIGATING", "system", "signal_returned")
            else:
                self._row(e, g, "policy", "candidate_linked")
            return
        d, _, d_why = self._decide(look, e["time"], False)
        if urgent and d:
            self._promote(e, d, look, d_why)
        elif urgent:
            g = self._open(e, look, True)
            self._link(e, g, look, "create", why)
            for other in related:
                self._tell("link", e, incident_id=g.gid, candidate_id=c, kind="related_to", evidence=_JSON(why | {"related_incident": other.gid}))
            self._row(e, g, "policy", "incident_created")
        elif d:
            self._link(e, d, look, "digest", d_why)
        else:
            self._link(e, self._open(e, look, False), look, "digest", {})

    def _check_recovery(self, e: dict) -> None:
        g = self.home.get(e["candidate_id"])
        if g and g.incident and g.status not in ("RECOVERING", *TERMINAL):
            last = FOREVER if g.open else g.last
            if last + self.hysteresis <= e["time"]:
                self._move(e, g, "RECOVERING", "system", "signals_recovered")

    def _command(self, e: dict) -> None:
        g, to = self.groups.get(e["incident_id"]), self.groups.get(e["target_id"])
        merge = e["command"] == "merge"
        status = "DISMISSED" if merge else COMMANDS.get(e["command"])
        allowed = g and self.moves.get((g.status, status), ())
        why = "unknown incident" if not g or not g.incident or (merge and (not to or not to.incident)) else "unknown command" if not status else "no reason" if not merge and not e["reason"] else "not allowed" if e["actor"] not in allowed else ""
        if why:
            self._tell("rejected", e, incident_id=e["incident_id"], actor=e["actor"], kind=e["command"], reason=why)
        elif merge:
            self._reach(to)
            for c in sorted(g.members):
                self._link(e, to, self.looks[c], "merge", {"from": g.gid, "by": e["actor"]})
            self._row(e, to, e["actor"], f"merged from {g.gid}: {e['reason'] or ''}")
            self._move(e, g, "DISMISSED", e["actor"], f"merged into {to.gid}: {e['reason'] or ''}")
        else:
            self._move(e, g, status, e["actor"], e["reason"])

    def _reach(self, g: _Group) -> None:
        """A group that changes may be reached again."""
        self.far.pop(g.gid, None)
        self.near[g.gid] = g
        g.wake()

    def _tidy(self, e: dict) -> None:
        """Whatever ended more than a gap before the earliest start still to come is out of reach, and what ended long ago is set aside."""
        if e["ahead"] > self.ahead:
            self.ahead = e["ahead"]
        self.tidied = e["time"]
        least, recent = self.ahead - self.gap, e["time"] - RECENT - self.gap
        for g in [g for g in self.near.values() if g.over() or (not g.open and g.last < max(least, recent))]:
            del self.near[g.gid]
            if not g.over() and g.last >= least:
                self.far[g.gid] = g
            else:
                g.rest()
        for g in [g for g in self.far.values() if g.over() or g.last < least]:
            del self.far[g.gid]
            g.rest()

    def _note(self, e: dict) -> None:
        """An impact or an investigation of an incident."""
        g = self.groups.get(e["incident_id"])
        if not g or not g.incident:
            self._tell("rejected", e, incident_id=e["incident_id"], actor=e["actor"], kind=e["kind"], reason="unknown incident")
        elif e["kind"] == "impact":
            self._row(e, g, "system", "impact_estimated")
        elif e["command"] == "start" and g.status == "DETECTED":
            self._move(e, g, "INVESTIGATING", "system", "investigation_started")
        else:
            self._row(e, g, "system", f"investigation_{'started' if e['command'] == 'start' else 'finished'}")

    def apply(self, e: dict) -> list[dict]:
        """The rows that an event gives."""
        self.out = []
        kind = e["kind"]
        if kind in ("detected", "checkpoint"):
            self._look(e)
        elif kind == "recovered":
            for g in self.inside.get(e["candidate_id"], ()):
                g.open -= e["candidate_id"] not in self.recovered
                g.last = max(g.last, e["time"])
                if g.gid in self.far:
                    self._reach(g)
            self.recovered[e["candidate_id"]] = e["time"]
        elif kind == "recovery_check":
            self._check_recovery(e)
        elif kind == "human":
            self._command(e)
        else:
            self._note(e)
        if e["time"] >= self.tidied + max(self.gap, 1):
            self._tidy(e)
        return self.out


class Columns:
    """Events from columns: their values are taken a column at a time, and equal lists become one frozenset."""

    NAMES = ("run_id", "island", "time", "nth", "kind", "candidate_id", "by_id", "incident_id", "target_id", "actor", "command", "reason", "start", "route", "verified", "decision_id")
    LISTS = ("groups", "locus", "parent")

    def __init__(self) -> None:
        self.sets: dict[tuple, frozenset] = {}

    def _sets(self, column: pa.ListArray) -> list[frozenset]:
        values, found, at = column.flatten().to_pylist(), [], 0
        if len(self.sets) > MOST_VERDICTS:
            self.sets.clear()
        for n in pc.fill_null(pc.list_value_length(column), 0).to_numpy().tolist():
            own = tuple(values[at : at + n])
            at += n
            if own not in self.sets:
                self.sets[own] = frozenset(own)
            found.append(self.sets[own])
        return found

    def events(self, batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
        def column(name: str) -> pa.Array:
            c = batch.column(name)
            return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

        def plain(c: pa.Array) -> list:
            # numbers with nulls would become floats
            return c.to_pylist() if c.null_count and pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False).tolist()

        names = (*self.NAMES, *self.LISTS)
        for row in zip(*(plain(column(n)) for n in self.NAMES), *(self._sets(column(n)) for n in self.LISTS)):
            yield dict(zip(names, row))


def rows_of(out: list[dict]) -> pa.RecordBatch:
    """A batch of the fold's rows."""
    return pa.RecordBatch.from_arrays([pa.array(values, c.type) for c, values in zip(_SCHEMA, zip(*map(_VALUES, out)))], schema=_SCHEMA)


def _folded(rules: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own, out, columns = None, None, [], Columns()
        for batch in batches:
            for e, lag in zip(columns.events(batch), batch.column("lag").to_pylist()):
                # looks still to come began no longer before than the island's slowest did
                e["ahead"] = FOREVER if lag is None else e["time"] - lag
                if fold is None or own != (e["run_id"], e["island"]):
                    fold, own = Fold(**rules), (e["run_id"], e["island"])
                out += fold.apply(e)
                if len(out) > 5_000:
                    yield rows_of(out)
                    out = []
        if out:
            yield rows_of(out)

    return run


_SCHEMA = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[t]) for c, t in (x.split() for x in _OUT.split(", "))])
_NOTHING, _VALUES = dict.fromkeys(_SCHEMA.names), itemgetter(*_SCHEMA.names)


def ready(events: DataFrame, renewal_with_approval: bool = False) -> DataFrame:
    """What the fold reads of EVENT's columns and island, with places in the order of events and metric groups."""
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    groups = metric_groups(F.col("metric"), F.col("direction"), renewal_with_approval)
    own = [c for c in Columns.NAMES if c not in ("nth", "by_id")]
    return events.select(*own, "locus", "parent", nth.cast("int").alias("nth"), F.coalesce("candidate_id", "incident_id").alias("by_id"), groups.alias("groups"))


class Candidates(NamedTuple):
    """Events with a candidate, what is known of each, and its first chains: the same whatever is asked of incidents."""

    events: DataFrame
    per: DataFrame
    chained: DataFrame


def candidates_of(events: DataFrame, gap: int = GAP, renewal_with_approval: bool = False) -> Candidates:
    """Of stored events with a candidate (columns of EVENT), which are read twice."""
    e = events.withColumn("run_id", F.coalesce("run_id", F.lit("")))
    looks = F.col("kind").isin("detected", "checkpoint")
    groups = metric_groups(F.col("metric"), F.col("direction"), renewal_with_approval)
    per = e.groupBy("run_id", "candidate_id").agg(
        F.min(F.when(looks, F.col("start"))).alias("start"), F.max(F.when(F.col("kind") == "recovered", F.col("time"))).alias("recovered"), F.max("time").alias("last"),
        F.min_by(F.when(looks, groups), F.when(looks, F.col("time"))).alias("groups"),
    )
    per = materialized(per.where("start is not null"), "fold-candidates")
    until = F.when(F.col("recovered").isNotNull(), F.greatest("recovered", "last"))
    return Candidates(e, per, first_chains(per.select("run_id", "candidate_id", "start", until.alias("until"), "groups"), gap))


def fold_incidents(events: DataFrame, gap: int = GAP, hysteresis: int = 0, mode: str = "pairs", ingestion_anchors: bool = False, renewal_with_approval: bool = False, parent_locus: bool = False) -> DataFrame:
    """The fold's rows in order (island, step): part event, link, digest or rejected, with that part's columns.

    events: the columns of EVENT. detected and checkpoint carry a candidate's look (metric to decision_id); recovered and
    recovery_check its id; human, impact and investigation an incident_id, and human a command, a merge with target_id.
    A command that isn't allowed changes nothing and gives a rejected row. Of one moment's events kinds count in the
    order of KINDS, then ids. Defined cases: an empty table gives an empty result; looks without a run are one run;
    commands for incidents that no candidate could have opened are rejected in an island of their own.
    """
    e = materialized(events.select(*(x.split()[0] for x in EVENT.split(", "))), "fold-events")
    known = candidates_of(e.where("candidate_id is not null"), gap, renewal_with_approval)
    return fold_candidates(known, e.where("candidate_id is null"), gap, hysteresis, mode, ingestion_anchors, renewal_with_approval, parent_locus)


def fold_candidates(known: Candidates, asked: DataFrame | None = None, gap: int = GAP, hysteresis: int = 0, mode: str = "pairs", ingestion_anchors: bool = False, renewal_with_approval: bool = False, parent_locus: bool = False) -> DataFrame:
    """fold_incidents of candidates_of(events, gap, renewal_with_approval) and stored events without a candidate, if any."""
    merges, every = None, known.events.withColumn("seed", F.col("candidate_id"))
    if asked is not None:
        asked = asked.withColumn("run_id", F.coalesce("run_id", F.lit("")))
        by_incident = known.per.select("run_id", incident_id(F.col("candidate_id")).alias("incident_id"), "candidate_id")
        merges = asked.where("command = 'merge'").select("run_id", "incident_id", "target_id")
        merges = merges.join(by_incident.withColumnRenamed("candidate_id", "a"), ["run_id", "incident_id"]).join(by_incident.select("run_id", F.col("candidate_id").alias("b"), F.col("incident_id").alias("target_id")), ["run_id", "target_id"])
        merges = materialized(merges.select("run_id", "a", "b"), "merges")
        merges = None if merges.isEmpty() else merges
        # rows of incidents go where their first candidate is
        every = every.unionByName(asked.join(by_incident.withColumnRenamed("candidate_id", "seed"), ["run_id", "incident_id"], "left"))
    chained, mixed = known.chained, ingestion_anchors or renewal_with_approval
    if merges is None:
        of = islands_of(chained, gap, None, mixed)
    else:
        runs = merges.select("run_id").distinct()
        of = islands_of(chained.join(runs, "run_id", "left_anti"), gap, None, mixed).unionByName(whole_islands(chained.join(runs, "run_id", "left_semi"), merges, gap))
    every = every.join(of.select("run_id", F.col("candidate_id").alias("seed"), "island"), ["run_id", "seed"], "left").where("island is not null or candidate_id is null")
    every = ready(every.withColumn("island", F.coalesce("island", F.lit(""))), renewal_with_approval)
    ordered = every.repartition("run_id", "island").sortWithinPartitions("run_id", "island", "time", "nth", "by_id", "command", "target_id", "reason")
    # how long before it was seen an island's slowest look began; the window keeps the rows' order, so they are sorted once
    lag = F.max(F.when(F.col("nth") < 2, F.col("time") - F.col("start"))).over(W.partitionBy("run_id", "island"))
    ordered = ordered.withColumn("lag", lag)
    rules = {"gap": gap, "hysteresis": hysteresis, "mode": mode, "ingestion_anchors": ingestion_anchors, "parent_locus": parent_locus}
    return materialized(ordered.mapInArrow(_folded(rules), _OUT), "fold")


def incident_events(fold: DataFrame) -> DataFrame:
    return fold.where("part = 'event'").select("run_id", "incident_id", "seq", F.col("time").alias("event_time"), "status", "actor", "reason", "step", "cause_kind", "cause_id")


def incident_links(fold: DataFrame) -> DataFrame:
    return fold.where("part = 'link'").select("run_id", "incident_id", "candidate_id", F.col("time").alias("linked_at"), "kind", "evidence", "step")


def digest_items(fold: DataFrame) -> DataFrame:
    return fold.where("part = 'digest'").select("run_id", F.col("group_id").alias("digest_group_id"), "candidate_id", "time", "decision_id", "promoted_to", "step")


def rejected_commands(fold: DataFrame) -> DataFrame:
    return fold.where("part = 'rejected'").select("run_id", "incident_id", "time", "actor", F.col("kind").alias("command"), F.col("reason").alias("why"))


def incident_snapshots(events: DataFrame, links: DataFrame, looks: DataFrame, notes: DataFrame) -> DataFrame:
    """One snapshot for every row of events (incident_events, all or the latest of each): the incident as known then.

    looks: run_id, candidate_id, time, nth (0 detected, 1 checkpoint), metric, direction, start, locus, window_end,
    verified, incident_p, severity_level, categories, evidence_ids, decision_id, route_source and policy_version. notes:
    run_id, incident_id, time, nth, impact, status and report (texts) of impacts and investigations.
    A member counts from its link on, with its last look up to the row; the one of the finest locus gives the affected
    dimensions, the last verified one category, severity and confidence, the earliest title and policy.
    """
    key = ["run_id", "incident_id", "seq"]
    when = lambda t, n, c: F.struct(F.col(t).alias("t"), F.col(n).cast("int").alias("n"), F.col(c).alias("c"))
    rows = events.select(*key, "event_time", "status", F.col("step").alias("at"), when("event_time", "cause_kind", "cause_id").alias("until"))
    own = links.where("kind != 'related_to'").groupBy("run_id", "incident_id", "candidate_id").agg(F.min("step").alias("since"), F.min("linked_at").alias("linked_at"))
    members = rows.join(own, ["run_id", "incident_id"]).where("since <= at").select(*key, "until", "candidate_id", "linked_at")
    look = F.struct(*(c for c in looks.columns if c not in ("run_id", "candidate_id", "time", "nth")))
    seen = looks.select("run_id", "candidate_id", when("time", "nth", "candidate_id").alias("seen"), look.alias("look"))
    known = members.join(seen, ["run_id", "candidate_id"]).where("seen <= until").groupBy(*key, "candidate_id").agg(F.max_by("look", "seen").alias("m"), F.min("linked_at").alias("linked_at"))
    per = known.groupBy(*key).agg(
        F.min_by("m", F.struct("m.start", "candidate_id")).alias("first"), F.min("m.start").alias("started_at"), F.min("linked_at").alias("detected_at"),
        F.max_by("m", F.struct(F.size("m.locus").alias("n"), (-F.col("m.start")).alias("s"), "candidate_id")).alias("anchor"),
        F.max_by("m", F.when(F.col("m.verified"), F.struct("m.window_end", "candidate_id"))).alias("latest"),
        F.array_sort(F.collect_list("candidate_id")).alias("linked_anomalies"), F.collect_set("m.evidence_ids").alias("evidence"), F.collect_set("m.decision_id").alias("decisions"),
    )
    said = notes.select("run_id", "incident_id", when("time", "nth", "incident_id").alias("seen"), "impact", "status", "report")
    said = rows.select(*key, "until").join(said.withColumnRenamed("status", "told"), ["run_id", "incident_id"]).where("seen <= until").groupBy(*key).agg(
        F.max_by("impact", F.when(F.col("impact").isNotNull(), F.col("seen"))).alias("estimated_impact"), F.max_by("told", F.when(F.col("told").isNotNull(), F.col("seen"))).alias("investigation_status"), F.collect_set("report").alias("reports")
    )
    family = F.create_map(*(F.lit(x) for kv in FAMILY.items() for x in kv))[F.col("first.metric")]
    place = F.when(F.size("anchor.locus") > 0, F.array_join(F.array_sort("anchor.locus"), ", ")).otherwise("all traffic")
    evidence = F.array_sort(F.array_distinct(F.concat(F.flatten("evidence"), "decisions", F.coalesce("reports", F.array().cast("array<string>")))))
    return rows.join(per, key).join(said, key, "left").select(
        *key, "status", F.concat_ws(" ", F.coalesce(family, "first.metric"), "first.direction", F.lit("in"), place).alias("title"), "started_at", "detected_at", F.col("event_time").alias("last_updated_at"),
        F.array_sort("anchor.locus").alias("affected_dimensions"), F.get("latest.categories", F.lit(0)).alias("category"), F.slice("latest.categories", 1, 3).alias("hypotheses"),
        F.col("latest.severity_level").alias("severity"), F.col("latest.incident_p").alias("confidence"), "linked_anomalies", evidence.alias("evidence_ids"), "estimated_impact",
        F.coalesce("investigation_status", F.lit("not_started")).alias("investigation_status"), F.col("first.route_source").alias("route_source"), F.col("first.policy_version").alias("policy_version"),
    )


def latest(events: DataFrame) -> DataFrame:
    """The last row of every incident."""
    return events.groupBy("run_id", "incident_id").agg(F.max_by(F.struct(*(c for c in events.columns if c not in ("run_id", "incident_id"))), "seq").alias("x")).select("run_id", "incident_id", "x.*")
