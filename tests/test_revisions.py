from symweave.sources import revisions


def test_changes_between_revisions(spark):
    commits = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3), ("r4", 4)], "revision string, ordinal int")
    changes = spark.createDataFrame([("r1", "a/Old.java"), ("r2", "a/A.java"), ("r3", "a/A.java"), ("r3", "b/K.kt"), ("r3", "notes.md"), ("r4", "c/New.groovy")], "revision string, path string")
    assert {r.path for r in revisions.changed_files(commits, changes, "r1", "r3", "/ws/").collect()} == {"/ws/a/A.java", "/ws/b/K.kt"}
    assert revisions.changed_files(commits, changes, "gone", "r3", "/ws").count() == 0
    assert revisions.needs_full_scan(commits, None) and revisions.needs_full_scan(commits, "gone") and not revisions.needs_full_scan(commits, "r2")
