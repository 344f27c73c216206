import pytest

from gridloom.operators import cohort, labels

GRID = "x int, y int, z int, label int"


def cube(centre, others):
    out = [(1, 1, 1, centre)]
    places = [(1 + a, 1 + b, 1 + c) for a, b, c in labels.NEIGHBOURS]
    return out + [(*p, o) for p, o in zip(places, others)]


def test_neighbour_mode_takes_the_smallest_of_equals(spark):
    grid = spark.createDataFrame(cube(1001, [5] * 3 + [2] * 3 + [1001] * 20), GRID)
    got = [r for r in labels.neighbour_mode(grid, [1001], strict=False).collect() if (r["x"], r["y"], r["z"]) == (1, 1, 1)]
    assert got[0]["new_label"] == 2


@pytest.mark.parametrize("others", [[1001] * 26, [1032] * 26])
def test_neighbour_mode_without_a_usable_label_is_an_error(spark, others):
    grid = spark.createDataFrame(cube(1001, others), GRID)
    with pytest.raises(Exception, match="no label to take"):
        labels.neighbour_mode(grid, [1001, 1032]).collect()


def test_cleaning_leaves_no_replaced_label(spark):
    grid = spark.createDataFrame([(x, y, 0, 9 if (x + y) % 4 == 0 else x % 3 + 1) for x in range(8) for y in range(8)], GRID)
    clean = labels.clean_labels(grid, [9])
    assert clean.count() == 64 and clean.where("label = 9").isEmpty()
    assert labels.changed_count(grid, clean, ["x", "y", "z"]).first()[0] == grid.where("label = 9").count()


def test_edge_voxels_see_only_the_grid(spark):
    grid = spark.createDataFrame([(0, 0, 0, 7), (0, 0, 1, 3)], GRID)
    assert labels.neighbour_mode(grid, [7]).first()["new_label"] == 3


def names(spark, items, reference, present):
    i = spark.createDataFrame(items, "source string, pos int, label int, name string")
    r = spark.createDataFrame(reference, "pos int, name string, tissues array<int>")
    p = spark.createDataFrame(present, "source string, label int")
    return {(x["label"], x["name"]): x["tissues"] for x in labels.assign_tissues(i, r, p).collect()}


def test_name_rules(spark):
    items = [("a", k, k, n) for k, n in enumerate(["LeftAmygdala", "Vitamin E Tablet", "Unlabeled X", "Cerebral White Matter X", "CSF", "Left Basal Forebrain", "icc", "absent thing"], 1)]
    got = names(spark, items, [(1, "Left Amygdala", [4]), (2, "LeftAmygdala", [9])], [("a", k) for k in range(1, 8)])
    assert {n: t for (_, n), t in got.items()} == {
        "LeftAmygdala": [4], "Vitamin E Tablet": [0], "Unlabeled X": [0, 1, 2, 3, 4, 5], "Cerebral White Matter X": [3], "CSF": [1], "Left Basal Forebrain": [4], "icc": [1], "Background": [0],
    }


def test_a_stop_name_ends_its_source_only(spark):
    items = [("a", 1, 1, "CSF"), ("a", 2, 2, "Lesion"), ("a", 3, 3, "icc"), ("b", 1, 4, "icc b")]
    got = names(spark, items, [(1, "none", [1])], [("a", 1), ("a", 2), ("a", 3), ("b", 4)])
    assert {n for _, n in got} == {"CSF", "icc b", "Background"}


def test_an_unknown_name_is_an_error(spark):
    with pytest.raises(Exception, match="unknown class of Thing"):
        names(spark, [("a", 1, 1, "Thing")], [(1, "none", [1])], [("a", 1)])


def test_remap_and_reconcile(spark):
    rows = spark.createDataFrame([(12,), (13,), (16,), (24,)], "label int")
    mapping = spark.createDataFrame([(12, 6), (16, 7), (24, 8)], "original int, consecutive int")
    met, missing = labels.remap(rows, mapping)
    assert {(r["label"], r["new_label"]) for r in met.collect()} == {(12, 6), (16, 7), (24, 8)}
    assert [r["label"] for r in missing.collect()] == [13]
    known = mapping.select(mapping.original.alias("label"))
    assert {tuple(r) for r in labels.reconcile(rows, known.where("label <> 24"), "label").collect()} == {(13, "unknown"), (24, "unknown")}


def test_natural_order(spark):
    df = spark.createDataFrame([("HLN-12-10",), ("HLN-12-2",), ("HLN-12-1",)], "name string")
    assert [r["name"] for r in cohort.natural_rank(df).orderBy("position").collect()] == ["HLN-12-1", "HLN-12-2", "HLN-12-10"]


def test_cohorts(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert cohort.leave_one_out(df).count() == 6
    out = cohort.at_positions(df, [0, 1])
    assert {tuple(r) for r in cohort.leave_specified_out(df, out).collect()} == {("A", "C"), ("B", "C")}
    for bad in (3, -1):
        with pytest.raises(Exception, match="no name at position"):
            cohort.at_positions(df, [bad]).collect()


def test_positional_zip_needs_equal_lengths(spark):
    a, b = spark.createDataFrame([("a1",), ("a2",)], "l string"), spark.createDataFrame([("b1",)], "r string")
    with pytest.raises(Exception, match="differ in length"):
        cohort.zip_by_position(a, b, "l", "r").collect()


def test_positions_over_many_ranges(spark):
    names = [f"n{k}" for k in range(500)]
    df = spark.createDataFrame([(n,) for n in sorted(names, reverse=True)], "name string").repartition(7)
    got = {r["name"]: r["position"] for r in cohort.natural_rank(df).collect()}
    assert got == {f"n{k}": k for k in range(500)}
    assert cohort.natural_rank(df.limit(0)).count() == 0
