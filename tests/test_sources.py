import pytest
from pyspark.sql import types as T

from chronoweave.plans.cohort import save_cohort
from chronoweave.schemas import METRIC_ROWS
from chronoweave.sources import runs, tables


@pytest.fixture
def run_tree(tmp_path):
    """Three runs with files as another tool leaves them; one without predictions, one hidden."""
    header = ",".join(METRIC_ROWS.names)
    for name, fold, model in (("version_3", 2, "LinearModel"), ("version_10", 0, "GRUModel"), (".hidden", 0, "X")):
        folder = tmp_path / "h32" / name
        folder.mkdir(parents=True)
        (folder / f"predictions_{fold}.csv").write_text(f"rn,mu,sigma,model\n1,0.5,0.1,{model}\n2,0.25,,{model}\n")
        (folder / "metrics.csv").write_text(f"{header},step\n{','.join([''] * 8)},1\n{','.join(['1.5'] * 8)},2\n")
    extra = tmp_path / "h32" / "version_4"
    extra.mkdir()
    (extra / "metrics.csv").write_text(f"epoch,{header}\n1,{','.join(['9.5'] * 8)}\n")
    return str(tmp_path / "h32")


def test_predictions_carry_fold_and_run(spark, run_tree):
    out = runs.read_predictions(spark, run_tree)
    got = {(r.run_folder, r.fold, r.run, r.model, r.group_folder) for r in out.collect()}
    assert got == {("version_3", 2, 3, "LinearModel", "h32"), ("version_10", 0, 10, "GRUModel", "h32")}
    assert out.count() == 4 and out.filter("sigma is null").count() == 2
    assert out.select(runs.swept_value()).first()[0] == 32.0
    assert {r.model for r in runs.run_models(spark, run_tree).collect()} == {"LinearModel", "GRUModel"}


def test_a_row_may_hold_the_name_of_a_column(spark, tmp_path):
    for n, model in enumerate(("mu", "mu", "other")):
        folder = tmp_path / "r" / f"version_{n} a+b"
        folder.mkdir(parents=True)
        (folder / "predictions_0.csv").write_text(f"rn,mu,sigma,model\n{n},0.5,0.1,{model}\n")
    out = runs.read_predictions(spark, str(tmp_path / "r")).collect()
    assert sorted((r.rn, r.mu, r.sigma, r.model, r.run) for r in out) == [
        (0, 0.5, 0.1, "mu", 0), (1, 0.5, 0.1, "mu", 1), (2, 0.5, 0.1, "other", 2)]
    assert sorted((r.run_folder, r.model) for r in runs.run_models(spark, str(tmp_path / "r")).collect()) == [
        ("version_0 a+b", "mu"), ("version_1 a+b", "mu"), ("version_2 a+b", "other")]


def test_odd_files(spark, tmp_path):
    """An empty file, one with a header alone, a row like the header, line breaks in quotes, columns in another order."""
    texts = ["", "rn,mu,sigma,model\n", "rn,mu,sigma,model\n1,2,3,sigma\n", 'model,"rn",sigma\n"a\nb",4,5\n"c,d",6,7\n', "mu,model\n8,x\n9,y\n"]
    for n, text in enumerate(texts):
        (tmp_path / "r" / f"version_{n}").mkdir(parents=True)
        (tmp_path / "r" / f"version_{n}" / "predictions_1.csv").write_text(text)
    kinds = {"rn": "long", "model": "string"}
    out = runs.read_by_header(spark, f"{tmp_path}/r/*/predictions*", ["rn", "mu", "sigma", "model"], kinds, multiline=True).collect()
    assert sorted((r.run, r.rn, r.mu, r.sigma, r.model) for r in out if r.run != 4) == [
        (2, 1, 2.0, 3.0, "sigma"), (3, 4, None, 5.0, "a\nb"), (3, 6, None, 7.0, "c,d")]
    assert sorted((r.mu, r.model, r.rn) for r in out if r.run == 4) == [(8.0, "x", None), (9.0, "y", None)]
    lines = runs.first_lines(spark, f"{tmp_path}/r/*/predictions*")
    assert [(f.names, f.fields) for f in lines][:2] == [(("rn", "mu", "sigma", "model"), ()), (("rn", "mu", "sigma", "model"), ("1", "2", "3", "sigma"))]
    assert runs.first_lines(spark, f"{tmp_path}/none/*") == []
    assert runs.read_predictions(spark, f"{tmp_path}/none").collect() == []


def test_first_lines_of_files_cut_into_blocks(spark, tmp_path):
    (tmp_path / "r" / "version_1").mkdir(parents=True)
    rows = "\n".join(f"{i},0.5,0.1,mu" for i in range(20_000))
    (tmp_path / "r" / "version_1" / "predictions_0.csv").write_text("rn,mu,sigma,model\n" + rows + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
        out = runs.read_predictions(spark, str(tmp_path / "r"))
        assert out.rdd.getNumPartitions() > 5 and out.count() == 20_000 and out.agg({"rn": "sum"}).first()[0] == 199_990_000
        assert runs.first_lines(spark, f"{tmp_path}/r/*/*")[0].fields == ("0", "0.5", "0.1", "mu")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_metrics_skip_runs_without_predictions_and_empty_rows(spark, run_tree):
    out = runs.read_run_metrics(spark, run_tree, "version")
    assert sorted((r.run_folder, r.model, r.rmse) for r in out.collect()) == [
        ("version_10", "GRUModel", 1.5), ("version_3", "LinearModel", 1.5)]
    everything = runs.read_metrics(spark, run_tree)
    assert {"epoch", "step"} <= set(everything.columns) and everything.filter("run_folder = 'version_4'").count() == 1


def test_csv_with_declared_schema(spark, tmp_path):
    df = spark.range(5).selectExpr("id as k", "id * 0.5d as v")
    tables.write_csv(df, str(tmp_path / "c"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    assert sorted(tables.read_csv(spark, str(tmp_path / "c"), schema).collect()) == sorted(df.collect())
    assert dict(tables.read_csv(spark, str(tmp_path / "c")).dtypes)["v"] == "double"


def test_numbered_csv(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, v string")
    tables.write_rows_csv(df, str(tmp_path / "n"), ["k"])
    back = tables.read_csv(spark, str(tmp_path / "n"))
    assert back.columns == ["rn", "k", "v"] and sorted(tuple(r) for r in back.collect()) == [(0, 1, "a"), (1, 2, "b"), (2, 3, "c")]


def test_table_view_and_order(spark, tmp_path):
    df = tables.save_table(spark.createDataFrame([(2, None), (1, 5)], "k long, v long"), str(tmp_path / "t"))
    tables.as_view(df, "some_rows")
    assert [r.k for r in tables.read_table(spark, "some_rows", ["v", "k"]).collect()] == [2, 1]
    assert tables.read_parquet(spark, str(tmp_path / "t"), df.schema).count() == 2


def test_cohort_files_hold_every_row_once(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 3, 1.0) for i in range(30)], "rn long, stay_id long, glc double")
    save_cohort(df, str(tmp_path / "main"), str(tmp_path / "val"))
    main, held = (tables.read_csv(spark, str(tmp_path / n)) for n in ("main", "val"))
    assert main.columns[0] == "rn" and sorted(r.rn for r in main.union(held).collect()) == list(range(30))
    assert held.select("stay_id").distinct().count() == 1 and "held_out" not in main.columns


def test_files_are_read_by_header_and_missing_files_give_no_rows(spark, tmp_path):
    for run, head, row in ((1, "rn,mu,sigma,model", "1,0.5,9.0,m"), (2, "rn,sigma,mu,model", "2,9.0,0.5,m"), (3, "model,rn,mu", "m,3,0.5")):
        folder = tmp_path / "runs" / f"version_{run}"
        folder.mkdir(parents=True)
        (folder / "predictions_0.csv").write_text(f"{head}\n{row}\n")
    out = runs.read_predictions(spark, str(tmp_path / "runs"))
    assert sorted((r.rn, r.mu, r.sigma, r.model, r.run) for r in out.collect()) == [(1, 0.5, 9.0, "m", 1), (2, 0.5, 9.0, "m", 2), (3, 0.5, None, "m", 3)]
    assert runs.read_metrics(spark, str(tmp_path / "runs")).count() == 0
    assert runs.read_run_metrics(spark, str(tmp_path / "none")).count() == 0


def test_pinned_tables_can_be_released(spark):
    from chronoweave import session

    before, session._pinned[:] = list(session._pinned), []
    session.pin(spark.range(3))
    assert session.release(spark) == 1 and session._pinned == []
    session._pinned[:] = before
