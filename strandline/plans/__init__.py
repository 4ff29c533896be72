"""Queries by problem and by operator family."""

from __future__ import annotations


def all_plans() -> list:
    from strandline.plans import p1_drift, p2_orphans, p3_parsing, p4_intervals, p5_duplicates, anchors, files, joins, media, parsers, questions, replies, texts

    return [m.R for m in (p1_drift, p2_orphans, p3_parsing, p4_intervals, p5_duplicates, anchors, files, joins, media, parsers, questions, replies, texts)]
