"""Invariants of the assignment over planted traces (sf0.01)."""

from collections import defaultdict

import pytest

from tracelens.plans.common import scored

from .conftest import SF_MID


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict(recursive=True) for r in scored(spark, SF_MID, "user").collect()]


def test_counts_add_up(rows):
    for r in rows:
        assert r["total_hedges"] == r["resolved_hedges"] + r["unresolved_hedges"] == len(r["matches"])


def test_resolved_means_later_verification_and_threshold(rows):
    for r in rows:
        for m in r["matches"]:
            if m["resolved"]:
                assert m["matched_verification"] is not None and m["match_score"] >= 0.6
                assert m["effective_weight"] < 1.0
            else:
                assert m["matched_verification"] is None and m["effective_weight"] == 1.0


def test_low_similarity_claims_are_exclusive(rows):
    # a verification resolved at sim <= 0.90 is never used again by a later
    # hedge at sim <= 0.90
    for r in rows:
        used = defaultdict(list)
        for m in r["matches"]:
            if m["resolved"] and m["subject_similarity"] <= 0.9:
                used[m["matched_verification"]].append(m["id"])
        assert all(len(v) == 1 for v in used.values())
