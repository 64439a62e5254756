"""Resolving issues changes their rows in place."""

import pytest

from quillspark.operators import records
from quillspark.sources.versioned import VersionedTables


@pytest.mark.parametrize("columns", [["issue_id"], ["section_id", "issue_id"]])
def test_resolved_issues_stay_as_many_as_they_are(spark, tmp_path, columns):
    issue = "struct<severity:string,issue_type:string,paragraph_id:string,description:string,recommendation:string>"
    schema = f"section_id string, reviewer_type string, decision string, payload_json string, created_at string, issues array<{issue}>"
    found = [("s1", "t", "REVISE", "{}", "t0", [("MAJOR", "X", "1", "d", "r"), ("MINOR", "X", "2", "d", "r")]), ("s2", "t", "REVISE", "{}", "t0", [("MINOR", "X", "1", "d", "r")])]
    tables = VersionedTables(spark, str(tmp_path), 2)
    for _ in range(2):
        records.save_reviews(tables, spark.createDataFrame(found, schema))
    ids = tables.read("review_issues").where("section_id = 's1' AND paragraph_id = '1'").select(*columns)
    records.resolve_issues(tables, ids)
    records.resolve_issues(tables, spark.createDataFrame([tuple("?" for _ in columns)], ", ".join(f"{c} string" for c in columns)))
    got = sorted((r["section_id"], r["paragraph_id"], r["status"]) for r in tables.read("review_issues").collect())
    assert got == [("s1", "1", "RESOLVED")] * 2 + [("s1", "2", "OPEN")] * 2 + [("s2", "1", "OPEN")] * 2
