"""The registered evaluation beside its oracle, and with parts that fail; the two learners are stood in for."""

import pytest
from compare import compare, connect

from catalog import pair_checks
from catalog.base import ORACLES, Tables
from semblance.plans import evaluate as plan

FOLDER = "/root/testdata/sf0.001"


def broken(*_, **__):
    raise ValueError("no report")


@pytest.mark.parametrize("part", [None, "synthetic_to_real_f1", "score_table"])
def test_failures_break_the_comparison(spark, monkeypatch, part):
    for name in ("membership_auc", "synthetic_to_real_f1"):
        monkeypatch.setattr(plan, name, lambda *_, **__: 0.5)
    if part:
        monkeypatch.setattr(plan, part, broken)
    problem = compare(pair_checks.evaluate_pair(Tables(spark, FOLDER)), connect(FOLDER), ORACLES["evaluate_pair"])
    assert (problem is None) == (part is None), problem
