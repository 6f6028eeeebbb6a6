"""Queries that read the bouts more than once read a stored table of them."""

import pytest

from duelframe.catalog import QUERIES


@pytest.mark.parametrize("name", ["score_upcoming", "matchup_scores"])
def test_bouts_are_made_once(spark, name):
    """What is returned does not put the lines together again."""
    files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
