"""What is kept between runs: memo of scores, verdicts after a change of journals, logs with undo."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import history, memo, revalidation

# --- memo -----------------------------------------------------------------------------------------------------------


def test_memo_computes_only_what_changed(spark, tmp_path):
    n, path = 12_005, str(tmp_path / "memo")
    rows = spark.range(n).select("id", F.concat(F.lit("Second language acquisition study "), F.col("id").cast("string")).alias("title"), F.lit("text").alias("abstract"), F.lit(None).cast("string").alias("issn"))
    score = lambda df: df.withColumn("score", F.length("title") + F.length("abstract"))
    run = lambda df, context="today": memo.memoise(df, "id", context, score, path, ("score",))
    told = lambda m: (m.computed, m.reused, m.forgotten)
    assert told(run(rows)) == (n, 0, 0) and told(run(rows)) == (0, n, 0)
    one = rows.withColumn("abstract", F.when(F.col("id") == 1, "other text").otherwise(F.col("abstract")))
    third = run(one)
    assert told(third) == (1, n - 1, 1)
    assert third.rows.where("score <> length(title) + length(abstract)").count() == 0 and third.rows.count() == n
    assert told(run(one.where("id < 12000"))) == (0, 12_000, 5) and told(run(one)) == (5, 12_000, 0)
    assert told(run(one, "tomorrow")) == (n, 0, n)
    assert told(run(one.where("false"), "tomorrow")) == (0, 0, n) and spark.read.schema("content string, part int").parquet(path).count() == 0


def test_memo_of_repeated_and_null_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None), (2, "")], "id long, t string")
    calls = []

    def score(rows):
        calls.append(rows.count())
        return rows.withColumns({"n": F.length("t"), "m": F.upper("t")})

    for _ in range(2):
        found = memo.memoise(df, "id", "x", score, str(tmp_path / "m"), ("n", "m"), parts=3).rows
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 1, "A"), (1, "a", 1, "A"), (1, "b", 1, "B"), (None, "c", 1, "C"), (None, None, None, None), (2, "", 0, "")], key=str)
    assert calls == [5]


# --- revalidation ---------------------------------------------------------------------------------------------------

JOURNALS = "journal_id long, name string, issn string, name_variants array<string>, blacklisted boolean"
ENTRIES = "journal_id long, catalog string, official boolean, ssci_indexed boolean, quartiles array<string>, zone int, load_ord long"
PAPERS = "id long, issn string, journal_name string, language string, status string"


def random_version(rng, journals, entries):
    journals, entries = [list(j) for j in journals], list(entries)
    for j in rng.sample(journals, 3):
        what = rng.choice(["name", "issn", "variants", "black"])
        if what == "name":
            j[1] = f"Journal {rng.randint(0, 60)}"
        elif what == "issn":
            j[2] = rng.choice([None, f"1234-{rng.randint(0, 40):03d}X"])
        elif what == "variants":
            j[3] = [f"Journal {rng.randint(0, 60)}"]
        else:
            j[4] = not j[4]
    return journals + [[900 + rng.randint(0, 90), f"Journal {rng.randint(0, 60)}", None, [], False]], rng.sample(entries, len(entries) - 3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_partial_revalidation_equals_the_whole(spark, tmp_path, seed):
    rng = random.Random(seed)
    j = [[i, f"Journal {i}", f"1234-{i:03d}X" if i % 3 else None, [f"J {i}"] if i % 4 == 0 else None, i % 11 == 0] for i in range(40)]
    e = [(rng.randint(0, 40), rng.choice(["cssci", "ssci_jcr", "ref_jcr", "ref_esci", "cn_core"]), rng.random() < 0.6, rng.random() < 0.8, [rng.choice(["Q1", "Q4"])], rng.choice([None, 2]), k) for k in range(80)]
    p = [(i, rng.choice([None, None, f"1234-{rng.randint(0, 45):03d}X", "bad"]), rng.choice([None, "", f"Journal {rng.randint(0, 65)}", f"J {rng.randint(0, 40)}"]), rng.choice(["zh", "en", None]), "pending") for i in range(400)]
    papers = spark.createDataFrame(p, PAPERS)
    new_j, new_e = random_version(rng, j, e)
    old, new = (spark.createDataFrame([tuple(r) for r in x], JOURNALS) for x in (j, new_j))
    old_e, new_e = spark.createDataFrame(e, ENTRIES), spark.createDataFrame(new_e, ENTRIES)
    path = str(tmp_path / "judged")
    revalidation.store(revalidation.judge(papers, old, old_e), path, 32)
    seen = revalidation.revalidate_changed(spark, path, old, new, old_e, new_e, 32)
    want = revalidation.judge(papers, new, new_e)
    told = lambda df: sorted(map(tuple, df.select("id", "status", "journal_id", "basis", "missing").collect()))
    assert told(revalidation.load(spark, path)) == told(want)
    before = {r.id: r.status for r in revalidation.judge(papers, old, old_e).collect()}
    after = {r.id: r.status for r in want.collect()}
    assert {r.id for r in seen.where("changed").collect()} == {i for i in after if before[i] != after[i]} and seen.count() < 200
    assert revalidation.revalidate_changed(spark, path, new, new, new_e, new_e, 32).count() == 0


def test_partial_revalidation_reads_only_its_parts(spark, tmp_path):
    papers = spark.createDataFrame([(i, None, f"Journal {i % 100}", "zh", "pending") for i in range(1000)], PAPERS)
    journals = spark.createDataFrame([(i, f"Journal {i}", None, None, False) for i in range(100)], JOURNALS)
    revalidation.store(revalidation.judge(papers, journals, spark.createDataFrame([], ENTRIES)), str(tmp_path / "j"), 64)
    keys = revalidation.keys_of(journals, journals.where("journal_id = 7"))
    parts = revalidation.affected_parts(spark, str(tmp_path / "j"), keys, 64)
    found = revalidation.affected(spark, str(tmp_path / "j"), keys, 64)
    assert len(parts) == 1 and found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*part#\d+ = {parts[0]}\)", plan) and not re.search(r"PartitionFilters: \[\], PushedFilters: [^\n]*journal_name", plan)


# --- history --------------------------------------------------------------------------------------------------------

LOG = "owner string, seq long, action_id long, undo_of long, kind string, subjects array<string>, value string"


def plain_history(log, at):
    """Snapshots before each action, restored by an undo that is allowed."""
    state, outcomes, actions = {}, {}, {}
    for owner, seq, action, undo_of, kind, subjects, value in sorted(log):
        if undo_of is None:
            own = sorted(set(subjects or ()))
            if not own or actions.get((owner, action), {}).get("live"):
                outcomes[owner, seq] = "refused"
            else:
                outcomes[owner, seq] = "done"
                actions[owner, action] = {"live": True, "seq": seq, "kind": kind, "before": {x: state.get((owner, kind, x)) for x in own}}
                if at is None or seq <= at:
                    state.update({(owner, kind, x): (value, seq) for x in own})
            continue
        a = actions.get((owner, undo_of))
        if not a or not a["live"]:
            outcomes[owner, seq] = "gone"
        elif any(b["live"] and o == owner and b["kind"] == a["kind"] and b["seq"] > a["seq"] and set(b["before"]) & set(a["before"]) for (o, _), b in actions.items()):
            outcomes[owner, seq] = "later action"
        else:
            outcomes[owner, seq] = "undone"
            a["live"] = False
            if at is None or seq <= at:
                state.update({(owner, a["kind"], x): v for x, v in a["before"].items()})
    return outcomes, sorted((*k, *v) for k, v in state.items() if v is not None)


def test_history(spark):
    rng = random.Random(5)
    log = []
    for owner in ("ann", "bo", None):
        for seq in range(150):
            undo = rng.random() < 0.45
            log.append((owner, seq, None if undo else rng.choice([seq, seq, rng.randint(0, 150)]), rng.randint(max(0, seq - 5), seq) if undo else None, rng.choice(["star", "tags"]), None if undo else rng.choices("pqrs", k=rng.randint(0, 3)), f"v{seq}"))
    given = [r for r in log if r[0] is not None]
    df = spark.createDataFrame(given, LOG).repartition(5)
    decided = history.decide(df)
    outcomes, _ = plain_history(given, None)
    assert {(r.owner, r.seq): r.outcome for r in decided.collect()} == outcomes and set(outcomes.values()) == {"done", "undone", "refused", "gone", "later action"}
    for at in (None, 0, 20, 77, 149):
        # what a later step does is no part of an earlier state
        cut = [r for r in given if at is None or r[1] <= at]
        assert sorted(map(tuple, history.as_of(df, decided, at).collect())) == plain_history(cut, None)[1]
    assert history.decide(df.where("false")).count() == 0


def test_an_undo_leaves_other_kinds_and_is_refused_after_a_later_action(spark):
    log = [("a", 1, 1, None, "browsed", ["p", "p", "q"], "yes"), ("a", 2, 2, None, "starred", ["p"], "no"), ("a", 3, 3, None, "note", ["p"], "later note"), ("a", 4, None, 2, None, None, None), ("a", 5, 5, None, "browsed", ["q"], "again"), ("a", 6, None, 1, None, None, None), ("a", 7, None, 5, None, None, None), ("a", 8, None, 1, None, None, None), ("a", 9, None, 1, None, None, None)]
    df = spark.createDataFrame(log, LOG)
    decided = history.decide(df)
    assert {r.seq: r.outcome for r in decided.where("undo_of is not null").collect()} == {4: "undone", 6: "later action", 7: "undone", 8: "undone", 9: "gone"}
    assert {(r.kind, r.subject): r.value for r in history.as_of(df, decided).collect()} == {("note", "p"): "later note"}
    assert {(r.kind, r.subject): r.value for r in history.as_of(df, decided, 5).collect()} == {("note", "p"): "later note", ("browsed", "p"): "yes", ("browsed", "q"): "again"}
