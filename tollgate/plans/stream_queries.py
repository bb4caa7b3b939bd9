"""Registered queries of decisions and of the event stream of incidents over the detector's own candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialized
from ..operators import decide as g
from ..operators import detect as d
from ..operators import incidents as h
from ..operators import stream_of_incidents as st
from .queries import END, START, add, norm


def decided(spark: SparkSession, sf_dir: str, looks: bool, source: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """Decisions by the states alone, as no answers are recorded, or all as incidents, and the candidates they are of."""
    events = materialized(norm(spark, sf_dir), "norm")
    cand = materialized(d.detect(events, START, END), "candidates")
    return st.decide_all(events, cand, START, END, source=source, looks=looks), cand


def _plain(df: DataFrame) -> DataFrame:
    """Maps and lists as text."""
    return df.withColumns({"provenance": F.to_json("provenance"), "scope": F.array_join("scope", ","), "locus": F.array_join("locus", ","), "evidence_ids": F.array_join("evidence_ids", ",")}).drop("categories")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, cand = decided(spark, sf_dir, True)
    return st.incident_event_stream(found, cand).withColumns({"locus": F.array_join("locus", ","), "parent": F.array_join("parent", ",")})


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From events to incidents: detected, analysed at every look, each taken as an incident, and folded."""
    found, cand = decided(spark, sf_dir, True, "all")
    return h.incident_events(h.fold_incidents(st.incident_event_stream(found, cand))).drop("cause_kind", "cause_id")


add("g2_g3_g11_decide_all", lambda s, sf: _plain(decided(s, sf, False)[0]).select("decision_id", "anomaly_id", "route", "rule", "reason", *g.STATE, "provenance", "state_hash"))
add("h1_incident_event_stream", _stream)
add("h1_h3_incidents_from_events", _incidents)
