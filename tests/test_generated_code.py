"""The JVM compiles no method of more than 8,000 bytes; longer ones are interpreted, row by row."""

import re

from duelframe.catalog import QUERIES


def test_engineered_rows_are_made_by_compiled_methods(spark, capsys):
    """Joining a bout and rounding all its features was one method of more than that."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # a plan that is final, with the join of large tables
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        QUERIES["engineer_full"](spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) > 5 and max(sizes) < 8_000
