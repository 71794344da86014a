"""Links from chunks of records are those of the pairs one by one."""

import __spark_entry__ as entry
from hearth.operators import linkage

ABBREVIATIONS, NICKNAMES = {"st": "street"}, {"bob": "robert", "robert": "robert"}


def test_chunks_give_the_similarities_of_every_pair(spark, monkeypatch):
    monkeypatch.setattr(linkage, "CHUNK", 3)
    monkeypatch.setattr(linkage, "AT_ONCE", 7)
    firsts, lasts = ["Bob", "robert", " r", "Ann", None, ""], ["Miller", "miler", "MILLER", "Öz", "Özil", None, "", "x" * 140]
    rows = [(f"r{i:02d}", "ab"[i % 2] if i != 5 else None, firsts[i % 6], lasts[i % 8], ["1980-02-03", "1980-02-09", "1980-05-01", None][i % 4], ["1 Main St", "1 main street", "", None, "2 Elm"][i % 5], ["85001", "85002", "", None, "85001"][i % 5]) for i in range(40)]
    records = spark.createDataFrame(rows, "id string, site_id string, first_name string, last_name string, dob string, address string, zip string")
    pairs = linkage.scored(linkage.similarities(linkage.blocked_pairs(records, salts=2), ABBREVIATIONS, NICKNAMES))
    want = sorted((r.left.id, r.right.id, *(round(r[c], 9) for c in (*linkage.SIMILARITIES, "probability"))) for r in pairs.collect())
    groups = linkage.scored(linkage.compared(records, None, ABBREVIATIONS, NICKNAMES))
    got = sorted((r.left_id, r.right_id, *(round(r[c], 9) for c in (*linkage.SIMILARITIES, "probability"))) for r in linkage.opened(groups).collect())
    assert len(want) > 50 and got == want
    assert groups.agg({"n": "sum"}).first()[0] == len(want)
    first = linkage.opened(linkage.compared(records, ids=1))
    assert first.count() == groups.count()


def test_no_pair_goes_to_python_as_a_row(spark, sf):
    """A task of a hundred thousand pairs would be given as many rows; chunks are few."""
    plan = entry.queries()["linkage_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
