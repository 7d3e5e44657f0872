"""Trees of files: one hash whatever the listing, and exactly what changed."""

import hashlib
import json

from arbiterlake.operators import assets
from arbiterlake.sources import snapshots


def test_trees(spark, tmp_path):
    def tree(name, files):
        for path, text in files.items():
            at = tmp_path / name / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
        return snapshots.tree_files(spark, str(tmp_path / name))

    one = {"a.txt": "1", "src/x.py": "2", "src/deep/er/y y+%.py": "é", "src/deep/z.py": "", "other/q": "5", "src/__pycache__/c.pyc": "no"}
    a, b = tree("one", one), tree("two", dict(reversed(one.items())))
    kept = {p: t for p, t in one.items() if "__pycache__" not in p}
    assert {r.path: (r.bytes, r.sha256) for r in a.collect()} == {p: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for p, t in kept.items()}
    entries = {p: {"sha256": hashlib.sha256(t.encode()).hexdigest(), "bytes": len(t.encode())} for p, t in kept.items()}
    whole = hashlib.sha256(json.dumps(entries, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [tuple(r) for r in snapshots.tree_snapshot(a).collect()] == [(whole, 5)] == [tuple(r) for r in snapshots.tree_snapshot(b.repartition(3)).collect()]
    folders = snapshots.folder_hashes(a)
    assert sorted(r.path for r in folders.collect()) == ["", "other", "src", "src/deep", "src/deep/er"]
    assert sorted(folders.collect()) == sorted(snapshots.folder_hashes(b.repartition(2)).collect())
    changed = {**kept, "src/x.py": "two", "new/n.txt": "n"}
    del changed["src/deep/z.py"]
    c = tree("three", changed)
    other = snapshots.folder_hashes(c)
    assert {tuple(r) for r in snapshots.tree_changes(a, c, folders, other).collect()} == {("src/x.py", "changed"), ("new/n.txt", "added"), ("src/deep/z.py", "removed")}
    assert snapshots.tree_changes(a, b, folders, folders).count() == 0
    assert [r.path for r in snapshots.tree_files(spark, str(tmp_path / "one"), ("a.txt", "src/deep")).orderBy("path").collect()] == ["a.txt", "src/deep/er/y y+%.py", "src/deep/z.py"]
    assert snapshots.folder_hashes(a.limit(0)).count() == 0


def test_drafts_stored(spark):
    corrections = spark.createDataFrame([("a", 1, "2024-01-02"), ("a", 2, "2024-01-05"), ("b", 1, "2024-01-02"), ("c", 1, "2024-01-02")], "asset_id string, revision_number int, created_at string")
    moves = spark.createDataFrame([("a", 1, "correction_drafting", "2024-01-01"), ("a", 2, "correction_drafting", "2024-01-05"), ("b", 1, "correction_drafting", "2024-01-03"), ("d", 1, "correction_drafting", "2024-01-01"), ("c", 1, "accepted", "2024-01-01")], "asset_id string, seq int, to_status string, created_at string")
    assert {tuple(r) for r in assets.drafts_stored(corrections, moves).collect()} == {("a", True), ("b", False), ("c", False), ("d", False)}


def test_candidates_out_of_reviews(spark):
    import pytest

    cases = spark.createDataFrame([(f"c{i}", f"ask {i}", "fam" if i == 2 else None, [f"s{i}"]) for i in range(7)], "case_id string, user_prompt string, pair_id string, allowed_sources array<string>")
    rows = [("r0", "c0", "pass", "P0"), ("r1", "c1", "fail", "P1"), ("r2", "c2", "fail", "P0"), ("r3", "c3", "partial", "P0"), ("r4", "c3", "fail", "P2"), ("r5", "c4", None, "P0"), ("r6", "c9", "fail", "P0"), ("r7", "c5", "partial", "P1"), ("r8", "c3", "partial", "P0"), ("r9", "c6", "odd", None)]
    reviewed = spark.createDataFrame(rows, "run_id string, sample_id string, human_pass_fail string, priority string")
    runs = spark.createDataFrame([(r[0], None if r[0] == "r4" else " " if r[0] == "r3" else f"answer {r[0]}") for r in rows], "run_id string, output_text string")
    got = {r.asset_id: r for r in assets.build_candidates(reviewed, runs, cases, per_type=2).collect()}
    # order of cases: c2 (fail P0), c1 (fail P1), c3 (fail P2, whose run has no answer: its next run that has one), c5, c0, c6
    assert {k: (r.source_case_id, r.source_run_id) for k, r in got.items()} == {
        "ASSET-SFT-001": ("c2", "r2"), "ASSET-SFT-002": ("c1", "r1"), "ASSET-PREFERENCE-001": ("c3", "r8"), "ASSET-PREFERENCE-002": ("c5", "r7"), "ASSET-REGRESSION-001": ("c0", "r0"), "ASSET-REGRESSION-002": ("c6", "r9"),
    }
    one = got["ASSET-SFT-001"]
    held = json.loads(one.source_snapshot)
    assert one.counterfactual_family_id == "fam" and held["allowed_sources"] == ["s2"] and held["source_output"] == "answer r2" and list(held) == sorted(held)
    assert one.source_snapshot_id == "SNAP-" + hashlib.sha256(one.source_snapshot.encode()).hexdigest()[:20]
    same = {r.asset_id: (r.source_case_id, r.evaluation_role) for r in assets.build_candidates(reviewed, runs, cases, per_type=2, same_source=True).collect()}
    assert same["ASSET-REGRESSION-001"] == ("c2", "same_source_bug_reproduction") and len(same) == 6
    with pytest.raises(ValueError, match="fewer than"):
        assets.build_candidates(reviewed, runs, cases, per_type=3)
    with pytest.raises(ValueError, match="no answer"):
        assets.build_candidates(reviewed, runs.filter("run_id not in ('r3', 'r4', 'r8')"), cases, per_type=2)


def test_assertions_and_checks(spark):
    from pyspark.sql import functions as F

    rows = [("a", ["clarify"], [], None, 1), ("b", [], [], None, 1), ("c", None, ["x"], None, 0), ("d", ["other"], [], ["t"], 2)]
    df = spark.createDataFrame(rows, "assertion_id string, expected_response_policy array<string>, forbidden_claims array<string>, required_topics array<string>, revision_number int")
    assert {tuple(r) for r in assets.assertion_violations(df).collect()} == {("b", "an assertion needs a condition"), ("c", "revisions count from 1"), ("d", "unknown or repeated policy")}
    names = ["pii_check", "duplicate_check", "source_traceability", "law_effective_date_check", "type_specific_check", "contamination_check"]
    made = spark.createDataFrame([["passed"] * 6, ["passed"] * 5 + ["failed"], ["passed"] * 5 + ["not_applicable"], [None] + ["passed"] * 5], ", ".join(f"{n} string" for n in names))
    assert [r[0] for r in made.select(assets.checks_passed()).collect()] == [True, False, True, False]
