import json

import pytest
from pyspark.sql import functions as F

from preflens.operators import report, winrate
from preflens.sources import artifacts, sinks, tables


@pytest.fixture()
def runs_dir(tmp_path):
    def write(run, name, content):
        folder = tmp_path / "runs" / run
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps(content, indent=2))

    write("dpo_b0.3", "config.resolved.json", {"stage": "dpo", "method": {"beta": 0.3}, "data": {}})
    write(
        "dpo_b0.3",
        "results.json",
        {
            "win_rate_mean": 0.542,
            "per_seed": [
                {"ci95": [0.48, 0.59], "swap_consistency": 0.75, "records": [{"prompt": "x"}]},
                {"ci95": [0.46, 0.57], "swap_consistency": 0.71},
            ],
        },
    )
    write("rm_full", "config.resolved.json", {"stage": "rm", "data": {"rm_pair_fraction": 1.0}})
    write("rm_full", "rm_eval.json", {"eval_accuracy": 0.7125, "n_train_pairs": 10})
    write(
        "grpo g8+x",
        "config.resolved.json",
        {"stage": "grpo", "method": {"beta": 0.04, "num_generations": 8, "reward_model_path": "runs/rm_full"}},
    )
    write("grpo g8+x", "diagnostics.json", {"length_reward_corr": 0.0625, "kl_from_reference": 0.0015})
    write("empty_seeds", "config.resolved.json", {})
    write("empty_seeds", "results.json", {"win_rate_mean": 0.5, "per_seed": []})
    write("no_config", "results.json", {"win_rate_mean": 0.9})
    write("rm_full/checkpoint-200", "config.resolved.json", {"stage": "rm"})
    (tmp_path / "runs" / "notes").mkdir()
    return str(tmp_path / "runs")


def test_runs_are_collected_from_their_artifacts(spark, runs_dir):
    board = artifacts.collect_runs(spark, runs_dir)
    rows = {r.run: r for r in board.collect()}
    assert set(rows) == {"dpo_b0.3", "rm_full", "grpo g8+x", "empty_seeds"}
    dpo = rows["dpo_b0.3"]
    assert (dpo.stage, dpo.beta, dpo.win_rate, dpo.ci_lo, dpo.ci_hi) == ("dpo", 0.3, 0.542, 0.46, 0.59)
    assert dpo.swap_consistency == pytest.approx(0.73) and dpo.kl is None
    assert rows["rm_full"].rm_accuracy == 0.7125 and rows["grpo g8+x"].num_generations == 8
    assert rows["empty_seeds"].stage == "" and rows["empty_seeds"].ci_lo is None


def test_markdown_table(spark, runs_dir):
    table = report.markdown_table(artifacts.collect_runs(spark, runs_dir)).split("\n")
    assert table[0] == (
        "| Run | Stage | beta | G | RM data | RM acc | Win-rate vs SFT | 95% CI | Swap cons. "
        "| len/reward rho | KL from ref |"
    )
    assert table[1] == "|---|---|---|---|---|---|---|---|---|---|---|"
    assert table[2] == "| dpo_b0.3 | dpo | 0.300 | — | — | — | 0.542 | [0.460, 0.590] | 0.730 | — | — |"
    assert table[3].startswith("| empty_seeds |  | — |")
    # Rounded like printf: 0.0625 is a tie and goes to the even digit.
    assert table[4] == "| grpo g8+x | grpo | 0.040 | 8 | — | — | — | — | — | 0.062 | 0.002 |"
    assert table[5].startswith(f"| rm_full | rm | — | — | 1.000 | {0.7125:.3f} |")


def test_stored_runs_are_analysed_again(spark, tmp_path):
    """Every field of the artifacts, from files to summaries, gap, flags and curve."""
    style = lambda h: {"header_rate": h, "bullet_rate": 0.1, "enthusiasm_rate": 0.2, "mean_chars": 90.5}
    record = lambda ab, ba, score: {"prompt": "p", "verdict_ab": ab, "verdict_ba": ba, "score": score, "len_policy": 7, "len_baseline": 5}
    for run, reward, rate in (("grpo_g4", 0.2, 0.55), ("grpo_g8", 0.4, 0.5)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.json").write_text(json.dumps({
            "policy": run, "judge": "rm", "n_prompts": 3, "seeds": [7], "win_rate_mean": rate, "win_rate_min": 0.5, "win_rate_max": 0.6,
            "per_seed": [{"seed": 7, "n": 3, "ci95": [0.1, 0.9], "swap_consistency": 1.0,
                          "records": [record("A", "B", 1.0), record("B", "A", 0.0), record("A", "A", 0.5)]}],
        }))
        (tmp_path / run / "diagnostics.json").write_text(json.dumps({
            "policy": run, "n_prompts": 3, "mean_rm_score_policy": reward, "rm_judged_win_rate": 0.7, "length_reward_corr": 0.6,
            "distinct_4_policy": 0.9, "distinct_4_reference": 0.8, "style_policy": style(0.5), "style_reference": style(0.4), "kl_from_reference": reward,
        }))
    (tmp_path / "dpo").mkdir()
    (tmp_path / "dpo" / "dpo_eval.json").write_text('{"beta": 0.2, "loss_type": "ipo", "eval_rewards/accuracies": 0.75}')
    folder = str(tmp_path)
    records = artifacts.read_records(spark, folder)
    summary = winrate.win_rate_summary(records, ["run_id", "seed"]).where("run_id = 'grpo_g4'").first()
    assert (summary.win_rate, summary.n, summary.swap_consistency) == (0.5, 3, pytest.approx(2 / 3))
    assert artifacts.read_results_by_seed(spark, folder).first().ci_hi == 0.9
    assert artifacts.read_results(spark, folder).where("run_id = 'grpo_g8'").first().win_rate_max == 0.6
    gaps = {r.run_id: r.goodhart_gap for r in artifacts.run_goodhart_gap(spark, folder).collect()}
    assert gaps == {"grpo_g4": pytest.approx(0.15), "grpo_g8": pytest.approx(0.2)}
    flags = artifacts.run_hacking_flags(spark, folder).first()
    assert flags.length_driven and flags.header_climbing and not flags.degenerate and not flags.bullet_climbing
    curve = {r.run_id: r.over_optimised for r in artifacts.run_overoptimisation_curve(spark, folder).collect()}
    assert curve == {"grpo_g4": False, "grpo_g8": True}
    dpo = artifacts.read_dpo_eval(spark, folder).first()
    assert (dpo.run_id, dpo.beta, dpo.loss_type, dpo.reward_accuracy) == ("dpo", 0.2, "ipo", 0.75)


def test_an_unknown_win_rate_is_never_the_peak(spark):
    nan = float("nan")
    rows = [("a", 0.1, nan), ("a", 0.2, 0.3), ("a", 0.3, None), ("b", 1.0, nan)]
    df = spark.createDataFrame(rows, "axis string, axis_value double, win_rate double")
    assert {(r.axis, r.best_value, r.win_rate) for r in report.axis_peak(df).collect()} == {("a", 0.2, 0.3), ("b", None, None)}
    points = df.selectExpr("*", "axis_value as reward", "axis_value as kl")
    assert not any(r.over_optimised for r in report.overoptimisation_curve(points).collect())


def test_log_tail_keeps_entries_whole(spark):
    log = spark.range(600).selectExpr("'r' as run_id", "id div 3 as step", "id % 3 as metric")
    tail = report.log_tail(log, 50)
    assert tail.count() == 150 and tail.agg(F.min("step")).first()[0] == 150


def test_a_folder_without_runs_gives_no_rows(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    assert artifacts.collect_runs(spark, str(tmp_path)).count() == 0


def test_malformed_artifacts_fail(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "config.resolved.json").write_text('{"stage": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        artifacts.collect_runs(spark, str(tmp_path)).collect()


def test_leaderboard_file(spark, runs_dir, tmp_path):
    board = artifacts.collect_runs(spark, runs_dir)
    sinks.write_leaderboard(board, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "\n".join(lines) == report.markdown_table(board)


def test_json_documents(spark, tmp_path):
    df = spark.sql("select 'r' as run_id, 0.5d as rate, date'2024-01-02' as day, null as gap, array(1, 2) as seeds")
    sinks.write_json(df, str(tmp_path / "all"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "all")).collect())
    assert text.count("\n") > 3
    assert json.loads(text) == {"run_id": "r", "rate": 0.5, "day": "2024-01-02", "gap": None, "seeds": [1, 2]}


def test_results_written_per_run_read_back(spark, tmp_path):
    by_seed = spark.createDataFrame(
        [("r", 0, 0.5, 0.4, 0.6, 0.8), ("r", 1, 0.7, 0.55, 0.9, 0.6)],
        "run_id string, seed int, win_rate double, ci_lo double, ci_hi double, swap_consistency double",
    )
    sinks.write_run_json(winrate.results_with_seeds(by_seed), str(tmp_path / "results"))
    files = list((tmp_path / "results" / "run_id=r").glob("part-*"))
    content = json.loads(files[0].read_text())
    assert content["win_rate_mean"] == pytest.approx(0.6)
    assert content["per_seed"][1]["ci95"] == [0.55, 0.9] and content["per_seed"][0]["seed"] == 0


def test_audit_rows_written_by_run_and_seed(spark, tmp_path):
    scored = spark.createDataFrame(
        [("r", 0, 1, "p" * 300, "pol", "base line", "A", "B", 1.0)],
        "run_id string, seed int, prompt_id int, prompt string, completion_policy string, "
        "completion_baseline string, verdict_ab string, verdict_ba string, score double",
    )
    sinks.write_audit(report.judgement_audit(scored, ["run_id", "seed", "prompt_id"]), str(tmp_path / "audit"))
    row = spark.read.parquet(str(tmp_path / "audit")).where("run_id = 'r' and seed = 0").first()
    assert len(row.prompt) == 200 and (row.len_policy, row.len_baseline) == (3, 9)
    assert row.policy_completion == "pol" and row.verdict_ba == "B"


def test_one_split_reads_its_files_only(spark, tmp_path):
    schema = tables.PREFERENCE_PAIRS
    rows = [(i, "q", [("user", "q")], [("user", "q")], "test_prefs" if i % 3 else "train_prefs") for i in range(9)]
    spark.createDataFrame(rows, schema).write.partitionBy("split").parquet(str(tmp_path / "p"))
    split = tables.read_split(spark, str(tmp_path / "p"), "train_prefs")
    assert sorted(r.pair_id for r in split.select("pair_id").collect()) == [0, 3, 6]
    plan = split.select("prompt")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<prompt:string>" in plan


def test_json_lines_split_fails_on_malformed_rows(spark, tmp_path):
    good = {"pair_id": 1, "prompt": "q", "chosen": [{"role": "user", "content": "c"}], "rejected": [], "split": "s"}
    (tmp_path / "a.json").write_text(json.dumps(good) + "\n")
    rows = tables.read_split(spark, str(tmp_path / "a.json"), "s", fmt="json").collect()
    assert rows[0].chosen[0].content == "c"
    (tmp_path / "b.json").write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_split(spark, str(tmp_path / "b.json"), "s", fmt="json").collect()


def test_over_optimisation_needs_reward_up_and_quality_not(spark):
    points = spark.createDataFrame(
        [("a", 1.0, 0.1, 0.5, 0.0), ("a", 2.0, 0.2, 0.6, 0.1), ("a", 3.0, 0.3, 0.6, 0.2),
         ("a", 4.0, 0.4, 0.5, 0.1), ("a", 5.0, 0.3, 0.4, 0.3), ("b", 1.0, 9.0, 0.1, None)],
        "axis string, axis_value double, reward double, win_rate double, kl double",
    )
    out = report.overoptimisation_curve(points).orderBy("axis", "axis_value").collect()
    assert [r.over_optimised for r in out] == [False, False, True, True, False, False]
    assert [r.kl_climbing for r in out] == [False, True, True, False, True, False]


def test_peak_takes_the_smallest_of_equals(spark):
    rows = [("a", 0.5, 0.6), ("a", 0.1, 0.6), ("a", 0.01, 0.4), ("b", 4.0, 0.2)]
    df = spark.createDataFrame(rows, "axis string, axis_value double, win_rate double")
    assert {(r.axis, r.best_value, r.win_rate) for r in report.axis_peak(df).collect()} == {
        ("a", 0.1, 0.6), ("b", 4.0, 0.2),
    }


def test_grid_names_carry_their_axis(spark):
    grid = {r.run_id: (r.axis, r.axis_value) for r in report.ablation_grid(spark).collect()}
    assert len(grid) == 9
    assert grid["dpo_b0.05"] == ("beta", 0.05) and grid["grpo_g16"] == ("num_generations", 16.0)
    assert grid["grpo_rm0.1"] == ("rm_fraction", 0.1)


def test_log_tail_is_cut_before_the_shuffle(spark):
    log = spark.range(1000).select(F.lit("r").alias("run_id"), F.col("id").alias("step"), F.lit(1.0).alias("v"))
    tail = report.log_tail(log.unionByName(log.where("step < 7").withColumn("run_id", F.lit("s"))))
    assert sorted(r.step for r in tail.where("run_id = 'r'").collect()) == list(range(950, 1000))
    assert tail.where("run_id = 's'").count() == 7
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_reward_model_beside_its_policy(spark):
    runs = spark.createDataFrame(
        [("p1", "grpo", None, "runs/rm", "runs/p1"), ("p2", "dpo", None, None, "runs/p2"), ("rm", "rm", 0.5, None, "runs/rm")],
        "run_id string, stage string, rm_pair_fraction double, reward_model_path string, output_dir string",
    )
    accuracy = spark.createDataFrame([("rm", 0.7)], "run_id string, eval_accuracy double")
    results = spark.createDataFrame([("p1", 0.6), ("p2", 0.4)], "run_id string, win_rate_mean double")
    rows = report.rm_quality_axis(runs, accuracy, results).collect()
    assert [(r.run_id, r.rm_run_id, r.rm_accuracy, r.win_rate_mean) for r in rows] == [("p1", "rm", 0.7, 0.6)]


def test_training_log_in_long_form(spark, tmp_path):
    (tmp_path / "g").mkdir()
    log = [{"step": 10, "reward": 0.5, "kl": 1e-3}, {"reward": 0.75, "note": "end"}]
    (tmp_path / "g" / "grpo_eval.json").write_text(json.dumps({"beta": 0.04, "log_history": log}))
    rows = artifacts.read_train_log(spark, str(tmp_path)).collect()
    assert {(r.run_id, r.entry, r.step, r.metric, r.value) for r in rows} == {
        ("g", 0, 10, "reward", 0.5), ("g", 0, 10, "kl", 0.001), ("g", 1, 1, "reward", 0.75), ("g", 1, 1, "note", None),
    }


def test_written_artifacts_are_read_back(spark, tmp_path):
    runs = str(tmp_path / "runs")
    rows = [("dpo_b0.3", '{"stage": "dpo"}'), ("grpo g8+x", '{\n "stage": "grpo"\n}'), ("a[1]*=%25", '{"stage": "rm"}')]
    df = spark.createDataFrame(rows, "run_id string, document string")
    sinks.write_artifacts(df, runs, "config.resolved.json")
    sinks.write_artifacts(df.where("run_id like 'dpo%'").withColumn("document", F.lit('{"stage": "new"}')), runs, "config.resolved.json")
    read = {r.run_id: r.stage for r in artifacts.read_runs(spark, runs).collect()}
    assert read == {"dpo_b0.3": "new", "grpo g8+x": "grpo", "a[1]*=%25": "rm"}
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == sorted(read)
    one = artifacts.read_artifact(spark, runs, "config.resolved.json", artifacts.CONFIG, runs=["a[1]*=%25"])
    assert [r.run_id for r in one.collect()] == ["a[1]*=%25"] and len(one.inputFiles()) == 1
    assert artifacts.read_artifact(spark, runs, "config.resolved.json", artifacts.CONFIG, runs=[]).count() == 0
    sinks.write_artifacts(df.limit(0), runs, "empty.json")


@pytest.mark.parametrize(
    "rows", [[("a", "2"), ("b", "fails")], [("a", "2"), ("a", "3")], [("a", "2"), (None, "3")], [("a", "2"), ("../b", "3")]]
)
def test_a_failing_write_leaves_the_runs_as_they_were(spark, tmp_path, rows):
    runs = tmp_path / "runs"
    frame = lambda r: spark.createDataFrame(r, "run_id string, document string")
    sinks.write_artifacts(frame([("a", "1")]), str(runs), "x.json")
    fails = F.when(F.col("document") == "fails", F.raise_error(F.lit("no"))).otherwise(F.col("document"))
    with pytest.raises(Exception):
        sinks.write_artifacts(frame(rows).withColumn("document", fails), str(runs), "x.json")
    assert [p.name for p in runs.iterdir()] == ["a"] and (runs / "a" / "x.json").read_text() == "1\n"
