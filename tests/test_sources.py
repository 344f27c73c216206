import gzip
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import resample
from gridloom.sources import adapters, files, nifti
from gridloom.streaming import incremental


@pytest.fixture
def volume(tmp_path):
    values = np.arange(3 * 4 * 5, dtype="i2").reshape(3, 4, 5) * 40
    affine = np.array([[2.0, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3], [0, 0, 0, 1]])
    path = str(tmp_path / "one.nii.gz")
    nifti.write_volume(path, values, affine)
    return path, values, affine


def test_volume_round_trip(volume):
    path, values, affine = volume
    header, got = nifti.read_volume(path, labels=True)
    assert np.array_equal(got[..., 0], values) and np.allclose(header.affine, affine) and header.spacing == (2, 3, 4)


def test_labels_beyond_2048_stay_exact(tmp_path):
    values = np.array([[[2049, 2051, 65520]]], "u2")
    nifti.write_volume(str(tmp_path / "x.nii"), values, np.eye(4))
    assert nifti.read_volume(str(tmp_path / "x.nii"), labels=True)[1].ravel().tolist() == [2049, 2051, 65520]


def test_data_source_forms(spark, volume, tmp_path):
    path, values, affine = volume
    spark.dataSource.register(nifti.NiftiDataSource)
    read = lambda **o: spark.read.format("nifti").options(**o).load(str(tmp_path))
    header = read(form="header").first()
    assert (header["nx"], header["ny"], header["nz"]) == values.shape and np.allclose(header["affine"], affine)
    vox = read(form="voxel", labels="true")
    assert {(r["x"], r["y"], r["z"]): r["label"] for r in vox.collect()} == {at: int(values[at]) for at in np.ndindex(values.shape)}
    blocks = read(block="2").collect()
    assert sum(len(r["values"]) for r in blocks) == values.size
    out = str(tmp_path / "out")
    vox.repartition(1).write.format("nifti").mode("append").option("path", out).save()
    assert np.array_equal(nifti.read_volume(f"{out}/one.nii.gz", labels=True)[1][..., 0], values)
    few = vox.where("label > 0 and x < 2").withColumns({"nx": F.lit(3), "ny": F.lit(4), "nz": F.lit(5)})
    few.repartition(1).write.format("nifti").mode("append").option("path", out).option("affine", ",".join(map(str, affine.ravel()))).save()
    header, got = nifti.read_volume(f"{out}/one.nii.gz", labels=True)
    assert got.shape == (3, 4, 5, 1) and np.allclose(header.affine, affine) and np.array_equal(got[:2, ..., 0], values[:2]) and not got[2].any()
    with pytest.raises(Exception, match="several tasks"):
        vox.repartition(3).write.format("nifti").mode("append").option("path", str(tmp_path / "split")).save()
    assert not list((tmp_path / "split").iterdir())


def test_sform_rewrite(volume, tmp_path):
    path, values, _ = volume
    new = np.diag([1.0, 2.0, 3.0, 1.0])
    out = nifti.rewrite_sform(path, new, str(tmp_path))
    assert out.endswith("one_mni_aligned.nii.gz") and np.allclose(nifti.read_header(out).affine, new)


def test_a_file_of_another_kind_is_an_error(tmp_path):
    (tmp_path / "x.nii.gz").write_bytes(gzip.compress(b"x" * 400))
    with pytest.raises(ValueError):
        nifti.read_header(str(tmp_path / "x.nii.gz"))


def test_structure_csv_round_trip(spark, tmp_path):
    (tmp_path / "s.csv").write_text('label,name,tissues\n4,"a, b","[1]"\n8,c,"[3, 4]"\n')
    df = files.read_structures(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in df.orderBy("label").collect()] == [(4, "a, b", [1]), (8, "c", [3, 4])]
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_structures(spark, str(tmp_path / "out")).exceptAll(df).isEmpty()


def test_label_xml(spark, tmp_path):
    (tmp_path / "l.xml").write_text(
        "<doc><tissues><item><number>0</number><name>bg</name></item><item><number>1</number><name>csf</name></item></tissues>"
        "<labels><item><number>12</number><name>x</name><tissues>0, 1</tissues></item></labels></doc>"
    )
    tissues, labels = files.read_label_xml(spark, str(tmp_path / "l.xml"))
    assert tissues.count() == 2 and tuple(labels.first()) == (12, "x", [0, 1])
    (tmp_path / "n.xml").write_text("<LabelList><Label><Number>3</Number><Name> A </Name></Label><Label><Number>4</Number><Name>B</Name></Label></LabelList>")
    assert {tuple(r) for r in files.read_named_labels(spark, str(tmp_path / "n.xml")).collect()} == {(3, "A"), (4, "B")}


def test_xml_tree(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<doc><a n='1'><b>1</b><b>2</b><c><d>x</d></c></a><a n='2'><b>3</b><c><d>y</d><d>z</d></c></a></doc>")
    got = {r["_n"]: (r["b"], r["c"]["d"]) for r in files.read_xml_tree(spark, str(tmp_path / "t.xml"), "a").collect()}
    assert got == {1: ([1, 2], ["x"]), 2: ([3], ["y", "z"])}


def test_text_matrix_and_listing(spark, tmp_path):
    (tmp_path / "affine.txt").write_text("1 0 0 2\n0 1  0 3\n0 0 1 4\n0 0 0 1\n\n")
    got = files.matrices(files.read_matrix(spark, str(tmp_path / "affine.txt"))).first()["matrix"]
    assert got == [[1, 0, 0, 2], [0, 1, 0, 3], [0, 0, 1, 4], [0, 0, 0, 1]]
    assert files.list_files(spark, str(tmp_path), "*.txt").first()["name"] == "affine.txt"
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "affine.txt")]) == str(tmp_path / "affine.txt")


def test_composed_affine(spark):
    a, s = [[2.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, -2.0], [0.0, 0.0, 0.5, 0.0], [0.0, 0.0, 0.0, 1.0]], np.eye(4).tolist()
    df = spark.createDataFrame([(a, s)], "affine array<array<double>>, sform array<array<double>>")
    assert np.allclose(resample.registered_sforms(df).first()["registered"], np.linalg.inv(a))
    assert np.allclose(resample.compose_inverse(a, s), np.linalg.inv(a))


def test_commands_report_exit_codes(spark):
    py = sys.executable
    work = spark.createDataFrame([("t", "a", "ok", [py, "-c", "pass"]), ("t", "b", "bad", [py, "-c", "import sys; sys.exit('no')"]), ("t", "c", "none", ["/no/such/program"])], "target string, name string, step string, command array<string>")
    got = {r["step"]: r["exit_code"] for r in adapters.Commands().run(work).collect()}
    assert got == {"ok": 0, "bad": 1, "none": -1}
    with pytest.raises(Exception, match="bad failed"):
        adapters.require_success(adapters.Commands().run(work.where("step = 'bad'"))).collect()
    line = adapters.Programs().nonlinear("i", "f", "a", "w", "c", target_mask="m")
    assert line[line.index("-sx") + 1] == "-5.0" and line[-2:] == ["-rmask", "m"]


def test_steps_of_a_pair_run_in_order_and_stop_at_a_failure(spark, tmp_path):
    py, log = sys.executable, str(tmp_path / "log")
    note = lambda x: [py, "-c", f"open({log!r}, 'a').write({x!r})"]
    rows = [("t", "a", 2, "last", note("3")), ("t", "a", 0, "first", note("1")), ("t", "a", 1, "middle", note("2")), ("t", "b", 0, "bad", [py, "-c", "import sys; sys.exit(3)"]), ("t", "b", 1, "after", note("x"))]
    work = spark.createDataFrame(rows, "target string, name string, position int, step string, command array<string>").repartition(4)
    got = {r["step"]: r["exit_code"] for r in adapters.Commands().run(work).collect()}
    assert got == {"first": 0, "middle": 0, "last": 0, "bad": 3, "after": adapters.SKIPPED}
    assert open(log).read() == "123"


def test_following_a_folder_takes_up_only_what_is_new(spark, tmp_path):
    work, out = str(tmp_path / "work"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(k,)], "k int").write.mode("append").parquet(work)
        incremental.follow(spark, work, "k int", lambda df: df.withColumn("r", F.col("k") * 10), out, f"follow-{tmp_path.name}").awaitTermination()
    assert sorted(r["r"] for r in spark.read.parquet(out).collect()) == [0, 10]


def test_windowed_votes_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1 voxel, 5 label, 0.5D weight union all select timestamp'2024-01-01 00:20:00', 1, 5, 0.25D union all select timestamp'2024-01-01 01:20:00', 1, 5, 1.0D")
    rows.write.parquet(str(tmp_path / "v"))
    q = incremental.windowed_votes(spark, str(tmp_path / "v"), rows.schema).writeStream.format("memory").queryName("votes_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["p"] for r in spark.table("votes_out").collect()) == [0.75, 1.0]
