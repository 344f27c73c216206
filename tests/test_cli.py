import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.sources import files, nifti, volumes


def write(path, values, affine=np.eye(4)):
    path.parent.mkdir(parents=True, exist_ok=True)
    nifti.write_volume(str(path), values, affine)


def test_evaluate(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    for s in ("s2", "s10"):
        truth = rng.integers(0, 3, (4, 5, 6)).astype("i2")
        write(tmp_path / "pred" / s / "parcellation.nii.gz", np.where(rng.random(truth.shape) < 0.2, 0, truth).astype("i2"))
        write(tmp_path / "gt" / s / "labels.nii.gz", truth)
    write(tmp_path / "pred" / "s11" / "parcellation.nii.gz", truth)
    argv = ["evaluate", "--pred-dir", str(tmp_path / "pred"), "--gt-dir", str(tmp_path / "gt"), "--out", str(tmp_path), "--exclude-background"]
    scores = cli.main(argv, spark)
    assert "s11: no ground truth" in capsys.readouterr().out
    got = {(r["subject"], r["label"]): r["dice"] for r in scores.collect()}
    assert set(got) == {(s, k) for s in ("s2", "s10") for k in (1, 2)}
    for (s, k), d in got.items():
        p, t = (nifti.read_volume(str(tmp_path / f), labels=True)[1] for f in (f"pred/{s}/parcellation.nii.gz", f"gt/{s}/labels.nii.gz"))
        assert d == pytest.approx(2 * ((p == k) & (t == k)).sum() / ((p == k).sum() + (t == k).sum()))
    assert files.read_scores(spark, str(tmp_path / "score.csv")).count() == 4
    write(tmp_path / "gt" / "s2" / "labels.nii.gz", truth, np.diag([2.0, 1, 1, 1]))
    with pytest.raises(SystemExit, match="s2"):
        cli.main(argv, spark)


def test_segment_skips_what_is_done(spark, tmp_path):
    rng = np.random.default_rng(2)
    truth = np.zeros((6, 6, 6), "i2")
    truth[1:5, 1:5, 1:5] = 1
    image = truth * 5.0 + rng.normal(0, 0.1, truth.shape)
    write(tmp_path / "t" / "a" / "image.nii.gz", image.astype("f4"))
    for k in ("b", "c"):
        write(tmp_path / "w" / "a" / k / "image.nii.gz", (image + rng.normal(0, 0.1, truth.shape)).astype("f4"))
        write(tmp_path / "w" / "a" / k / "labels.nii.gz", truth)
    write(tmp_path / "t" / "b" / "image.nii.gz", image.astype("f4"), np.diag([2.0, 1, 1, 1]))
    write(tmp_path / "w" / "b" / "c" / "image.nii.gz", image.astype("f4"))
    write(tmp_path / "w" / "b" / "c" / "labels.nii.gz", truth)
    (tmp_path / "s.csv").write_text('label,name,tissues\n0,bg,"[0]"\n1,x,"[1]"\n')
    (tmp_path / "ti.csv").write_text("label,name\n0,bg\n1,in\n")
    argv = ["segment", "--targets", str(tmp_path / "t"), "--warped", str(tmp_path / "w"), "--results", str(tmp_path / "r"), "--structures", str(tmp_path / "s.csv"), "--tissues", str(tmp_path / "ti.csv"), "--skip-existing"]
    assert cli.main([*argv, "--task-id", "0"], spark) == ["a"]
    got = nifti.read_volume(str(tmp_path / "r" / "a" / "parcellation.nii.gz"), labels=True)[1][..., 0]
    assert (got == truth).mean() > 0.95
    assert cli.main(argv, spark) == ["b"] and cli.main(argv, spark) == []
    header, got = nifti.read_volume(str(tmp_path / "r" / "b" / "parcellation.nii.gz"), labels=True)
    assert np.allclose(header.affine, np.diag([2.0, 1, 1, 1])) and got.shape == (6, 6, 6, 1)


PROGRAM = """#!{python}
import shutil, sys
a = dict(zip(sys.argv[1::2], sys.argv[2::2])) if len(sys.argv) % 2 else dict(zip(sys.argv[1:-1:2], sys.argv[2:-1:2]))
args = sys.argv
at = lambda name: args[args.index(name) + 1]
if "bad" in at("-flo"):
    sys.exit("cannot register")
if "-aff" in args and "-cpp" not in args:
    open(at("-aff"), "w").write("2 0 0 4\\n0 1 0 0\\n0 0 1 0\\n0 0 0 1\\n")
if "-cpp" in args:
    open(at("-aff")).read()
    open(at("-cpp"), "w").write("1")
shutil.copy(at("-flo"), at("-res"))
"""


def test_register_leaves_subjects_out(spark, tmp_path):
    for program in ("reg_aladin", "reg_f3d", "reg_resample"):
        (tmp_path / "bin").mkdir(exist_ok=True)
        (tmp_path / "bin" / program).write_text(PROGRAM.replace("{python}", sys.executable))
        (tmp_path / "bin" / program).chmod(0o755)
    for k, s in enumerate(("a1", "a2", "a10")):
        write(tmp_path / "atlas" / s / "image.nii.gz", np.full((2, 2, 2), float(k), "f4"))
        write(tmp_path / "atlas" / s / "labels.nii.gz", np.full((2, 2, 2), k, "i2"))
    base = ["register", "--atlas-root", str(tmp_path / "atlas"), "--warped", str(tmp_path / "w"), "--programs", str(tmp_path / "bin"), "--skip-existing"]
    assert cli.main([*base, "--task-id", "2"], spark) == [("a10", "a1"), ("a10", "a2")]
    assert nifti.read_volume(str(tmp_path / "w" / "a10" / "a2" / "labels.nii.gz"), labels=True)[1].max() == 1
    assert cli.main([*base, "--leave-out", "a1", "a10"], spark) == [("a1", "a2")]  # a10 with a2 is done
    assert cli.main([*base, "--limit", "2"], spark) == [("a1", "a10"), ("a2", "a1"), ("a2", "a10")]
    write(tmp_path / "atlas" / "bad" / "image.nii.gz", np.zeros((2, 2, 2), "f4"))
    write(tmp_path / "atlas" / "bad" / "labels.nii.gz", np.zeros((2, 2, 2), "i2"))
    with pytest.raises(Exception, match="affine failed for a1 and bad"):
        cli.main([*base, "--task-id", "0"], spark)
    with pytest.raises(Exception, match="no name at position 9"):
        cli.main([*base, "--task-id", "9"], spark)


def test_align_rewrites_headers(spark, tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "reg_aladin").write_text(PROGRAM.replace("{python}", sys.executable))
    (tmp_path / "bin" / "reg_aladin").chmod(0o755)
    box = np.arange(8, dtype="i2").reshape(2, 2, 2)
    for k in (1, 2):
        write(tmp_path / "in" / f"s{k}" / "image.nii.gz", box.astype("f4"), np.diag([float(k), 1, 1, 1]))
        write(tmp_path / "in" / f"s{k}" / "labels.nii.gz", box, np.diag([float(k), 1, 1, 1]))
    argv = ["align", "--root", str(tmp_path / "in"), "--template", str(tmp_path / "mni.nii.gz"), "--out", str(tmp_path / "out"), "--programs", str(tmp_path / "bin")]
    assert cli.main(argv, spark) == ["s1", "s2"]
    for name in ("image", "labels"):
        header, got = nifti.read_volume(str(tmp_path / "out" / "s2" / f"{name}_mni_aligned.nii.gz"), labels=True)
        assert np.allclose(header.affine, np.linalg.inv([[2, 0, 0, 4], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]]) @ np.diag([2.0, 1, 1, 1])) and np.array_equal(got[..., 0], box)


def test_clean(spark, tmp_path):
    box = np.full((4, 4, 4), 5, "i2")
    box[1, 1, 1], box[3, 3, 3] = 1001, 2001
    write(tmp_path / "s1" / "labels.nii.gz", box, np.diag([3.0, 1, 1, 1]))
    assert cli.main(["clean", "--root", str(tmp_path), "--replace", "1001", "2001"], spark) == 2
    header, got = nifti.read_volume(str(tmp_path / "s1" / "labels_cleaned.nii.gz"), labels=True)
    assert (got == 5).all() and header.affine[0, 0] == 3


def test_label_tables(spark, tmp_path):
    write(tmp_path / "s1" / "labels.nii.gz", np.array([[[0, 3, 4]]], "i2"))
    (tmp_path / "n.xml").write_text("<LabelList><Label><Number>3</Number><Name>Left A</Name></Label><Label><Number>4</Number><Name>Some White Matter</Name></Label><Label><Number>9</Number><Name>not there</Name></Label></LabelList>")
    (tmp_path / "r.xml").write_text("<doc><tissues><item><number>0</number><name>bg</name></item></tissues><labels><item><number>12</number><name>LeftA</name><tissues>2, 1</tissues></item></labels></doc>")
    cli.main(["labels", "--root", str(tmp_path), "--names", str(tmp_path / "n.xml"), "--reference", str(tmp_path / "r.xml"), "--out", str(tmp_path)], spark)
    got = {(r["label"], r["name"], tuple(r["tissues"])) for r in files.read_structures(spark, str(tmp_path / "structures_info.csv")).collect()}
    assert got == {(0, "Background", (0,)), (3, "Left A", (2, 1)), (4, "Some White Matter", (3,))}


def test_volumes_from_any_storage_and_of_one_channel_only(spark, tmp_path):
    write(tmp_path / "a.nii.gz", np.arange(24.0).reshape(2, 3, 4).astype("f4"))
    df = spark.read.format("binaryFile").load(str(tmp_path / "a.nii.gz")).select(F.lit("a").alias("subject"), "path", "content")
    assert volumes.voxels(df, content="content").agg(F.sum("value")).first()[0] == 276
    write(tmp_path / "two.nii.gz", np.zeros((2, 2, 2, 3), "f4"))
    with pytest.raises(Exception, match="3 channels"):
        volumes.voxels(spark.createDataFrame([("x", str(tmp_path / "two.nii.gz"))], "k string, path string")).count()


def test_voxels_without_a_header_are_an_error(spark, tmp_path):
    v = spark.createDataFrame([("a", 0, 0, 0, 1), ("b", 0, 0, 0, 2)], "subject string, x int, y int, z int, label int")
    h = spark.createDataFrame([("a", [2, 2, 2, 1], np.eye(4).tolist())], "subject string, shape array<int>, affine array<array<double>>")
    with pytest.raises(Exception, match="without a header"):
        volumes.write_volumes(v, h, str(tmp_path / "o")).collect()
    got = volumes.write_volumes(v.where("subject = 'a'"), h, str(tmp_path / "o")).first()
    assert got["voxels"] == 1 and nifti.read_volume(got["path"], labels=True)[1].shape == (2, 2, 2, 1)


def test_headers_read_no_values(spark, tmp_path):
    write(tmp_path / "x.nii.gz", np.zeros((2, 3, 4), "f4"), np.diag([1.0, 2, 3, 1]))
    df = spark.createDataFrame([("k", str(tmp_path / "x.nii.gz"))], "k string, path string")
    r = volumes.headers(df).first()
    assert (r["k"], r["shape"], r["spacing"]) == ("k", [2, 3, 4, 1], [1, 2, 3])
    assert volumes.voxels(df).count() == 24
