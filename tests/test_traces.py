"""Histories without copies, samples without whole strata in a task, diverse cards out of bounded cells."""

import random

from pyspark.sql import functions as F

from arbiterlake.operators import calibration, dashboard, traces


def test_histories_are_cut_out_of_one_array(spark, tmp_path):
    turns = spark.range(2000).selectExpr("1L trace_id", "id turn_index", "concat('r', id % 2) role", "repeat(concat('t', id), 20) content")
    traces.told(turns).write.parquet(f"{tmp_path}/told")
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "told").glob("*.parquet"))
    whole, stories = size(), spark.read.parquet(f"{tmp_path}/told")
    assert whole < 400_000 and stories.count() == 1  # 170 kB of texts, once
    asked = turns.filter("turn_index in (0, 3, 1999)").select("trace_id", "turn_index")
    got = {r.turn_index: r.history for r in traces.history(asked, stories).collect()}
    assert got[0] == [] and [(h.role, h.content[:2]) for h in got[3]] == [("r0", "t0"), ("r1", "t1"), ("r0", "t2")] and len(got[1999]) == 1999
    assert traces.history(asked.withColumn("trace_id", F.lit(9).cast("long")), stories).first().history == []


def test_promises_equal_plain_rule_without_workers(spark):
    rng = random.Random(11)
    pack = traces.TracePack(promises=("win.", "(sure)", "sure", "a"), negations=("not",), scoped_negations=("cannot say",), boundaries=(".", "but", "but then", "\n"))

    def plain(t):
        for p in pack.promises:
            at = t.find(p)
            while at >= 0:
                scope = t[max(0, at - 48) : at]
                cut = max([0, *(scope.rfind(b) + len(b) for b in pack.boundaries if b in scope)])
                near = scope[cut:][-12:] + t[at : at + len(p) + 4]
                if not any(n in near for n in pack.negations) and not any(n in scope[cut:] for n in pack.scoped_negations):
                    return True
                at = t.find(p, at + len(p))
        return False

    words = ["win.", "(sure)", "sure", "a", "not", "cannot say", "but", "then", ".", "\n", "🙂", "x" * 9, "漢字", " "]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", None]
    made = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", traces.overclaims(F.col("t"), pack).alias("y"))
    assert [r.y for r in sorted(made.collect())] == [plain(t or "") for t in texts] and 50 < sum(map(plain, texts[:-1])) < 580
    assert "Python" not in made._jdf.queryExecution().toString()


def test_sample_ranks_few_rows_of_a_large_stratum(spark, monkeypatch):
    ranked, write = [], calibration.materialize
    monkeypatch.setattr(calibration, "materialize", lambda df: (ranked.append(df), write(df))[1])
    df = spark.range(60_000).selectExpr("id run_id", "case when id % 1000 = 0 then null when id = 5 then 'few' else 'most' end s", "id % 7 other")
    got = calibration.stratified(df, 90, ("s",)).select("run_id").collect()
    order = calibration.hash_order("run_id", 42)
    want = []
    for cell in ("s is null", "s = 'few'", "s = 'most'"):
        want += df.filter(cell).orderBy(order, "run_id").limit(30).select("run_id").collect()
    assert sorted(got) == sorted(want) and len(got) == 61
    near = [d for d in ranked if "run_id" in d.columns]
    assert sum(d.filter("s = 'most'").count() for d in near) < 300
    same = spark.range(3000).selectExpr("1L run_id", "'x' s", "id n")  # one key: all rows in one place of the order
    assert calibration.stratified(same, 40, ("s",)).count() == 1
    assert calibration.stratified(df.limit(0), 5, ("s",)).count() == 0


def test_cards_equal_plain_greedy(spark):
    rng = random.Random(4)
    rows = [
        (f"r{i}", f"s{rng.randint(0, 12)}", f"V{rng.randint(0, 2)}", f"m{i % 3}", rng.choice(dashboard.CARD_TASKS + ("other",)), rng.choice(dashboard.CARD_POLICIES[:3] + ("odd",)), f"e{rng.randint(0, 6)}", rng.choice(["P0", "P1", "P2", None]), "released", rng.choice([0.1, 0.5, None]))
        for i in range(160)
    ]
    names = "run_id string, sample_id string, version string, model_alias string, task_category string, response_policy string, main_error_type string, priority string, workflow_status string, score_rate double"
    df = spark.createDataFrame(rows, names)
    rank = lambda r: ((dashboard.CARD_POLICIES.index(r[5]) + 1) if r[5] != "odd" else 6, r[4], int(r[7][1]) if r[7] else 3, 1.0 if r[9] is None else r[9], r[1], r[2], r[3], r[0])
    for limit in (3, 30, 70, 500):
        cards, chosen, keys = sorted(rows, key=rank), [], set()

        def first(group, most=1, again=False):
            for r in group:
                if most and r[0] not in [c[0] for c in chosen] and (again or (r[1], r[2], r[5]) not in keys):
                    chosen.append(r), keys.add((r[1], r[2], r[5]))
                    most -= 1

        for p in dashboard.CARD_POLICIES:
            for t in dashboard.CARD_TASKS:
                first([r for r in cards if (r[5], r[4]) == (p, t)])
        for cell in dict.fromkeys((r[5], r[6]) for r in cards):
            first([r for r in cards if (r[5], r[6]) == cell])
        first(cards, max(0, limit - len(chosen)))
        first(cards, max(0, limit - len(chosen)), True)
        made = dashboard.badcase_cards(df.drop("score_rate"), df.select("run_id", "score_rate"), limit)
        assert [r.run_id for r in made.orderBy("card_no").collect()] == [c[0] for c in chosen]
