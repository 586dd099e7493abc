"""The quality figures cover the checks of all three layers."""

from collections import Counter

from souk.queries.base import QUERIES
from souk.registry import QUERIES as ALL

SF = "/root/testdata/sf0.001"


def test_figures_have_every_check(spark):
    assert "quality_checks_all" in ALL
    rows = QUERIES["quality_checks_all"](spark, SF).collect()
    assert len(rows) == 88 and {r["layer"] for r in rows} == {"bronze", "silver", "gold"} and "suite_ran" not in {r["check_name"] for r in rows}
    status = Counter(r["status"] for r in rows)
    cards = QUERIES["fig_quality_cards"](spark, SF).first()
    assert (cards["checks"], cards["passed"], cards["in_warning"], cards["failed"]) == (88, status["passed"], status["warning"], status["failed"])
    matrix = {(r["layer"], r["dimension"]): (r["checks"], r["not_passed"]) for r in QUERIES["fig_quality_matrix"](spark, SF).collect()}
    each, bad = Counter((r["layer"], r["dimension"]) for r in rows), Counter((r["layer"], r["dimension"]) for r in rows if r["status"] != "passed")
    assert matrix == {k: (n, bad[k]) for k, n in each.items()}
    heat = {(r["layer"], d): r[d] for r in QUERIES["quality_heatmap"](spark, SF).collect() for d in r.asDict() if d != "layer" and r[d]}
    assert heat == dict(each)
