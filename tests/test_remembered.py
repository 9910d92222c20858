"""Stored profiles, declarations and overrides."""

from terrafold.sources import remembered as rm


def test_profiles_are_kept_while_files_are(spark, tmp_path):
    folder, store = f"file:{tmp_path}/in", f"file:{tmp_path}/store"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc")
    built = []

    def build(where):
        built.append(where)
        return spark.read.text(where)

    assert [r.value for r in rm.cached_profile(spark, folder, store, build).collect()] == ["abc"]
    (tmp_path / "in" / "a.txt").write_text("xyz")  # of equal size: the stored profile counts, the file is not read
    assert [r.value for r in rm.cached_profile(spark, folder, store, build).collect()] == ["abc"] and len(built) == 1
    assert [r.value for r in rm.cached_profile(spark, folder, store, build, rebuild=True).collect()] == ["xyz"]
    (tmp_path / "in" / "b.txt").write_text("more")
    assert sorted(r.value for r in rm.cached_profile(spark, folder, store, build).collect()) == ["more", "xyz"]
    assert rm.cached_profile(spark, folder, store, build, version=99).count() == 2 and len(built) == 4


def test_declarations_survive(spark, tmp_path):
    store = f"file:{tmp_path}/store"
    assert rm.declared(spark, store).count() == 0
    for at, value in ((1, "105"), (3, "111"), (2, "9")):
        rm.declare(spark, store, spark.createDataFrame([("inset_meridian", value, at), (f"k{at}", "v", at)], "key string, value string, at long"))
    assert {r.key: r.value for r in rm.declared(spark, store).collect()} == {"inset_meridian": "111", "k1": "v", "k2": "v", "k3": "v"}


def test_the_last_override_counts(spark, tmp_path):
    store = f"file:{tmp_path}/o"
    assert rm.stored_overrides(spark, store).count() == 0
    for rows in ([("Hà Nội", " Ba Đình ", 5, "x", 1), ("A", "b", 1, "one", 1)], [("hà nội", "ba đình", 7, "y", 2)], [("a", "B", None, None, 3)]):
        rm.store_overrides(spark.createDataFrame(rows, rm.OVERRIDES), store)
    assert [tuple(r) for r in rm.stored_overrides(spark, store).collect()] == [("hà nội", "ba đình", 7, "y")]
