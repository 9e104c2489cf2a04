"""User formats: splits, filters, streams of files that grow."""

import random

import pytest
from pyspark.sql import functions as F

from recordgate.sources import user_formats
from recordgate.sources.user_formats import Cells, LineReader, Split, files_of, lines_of
from recordgate.streaming import stream


@pytest.mark.parametrize("read", [3, 1 << 20])
def test_splits_give_each_line_once(tmp_path, monkeypatch, read):
    monkeypatch.setattr(user_formats, "READ", read)
    r = random.Random(read)
    for n in range(40):
        data = b"\n".join(bytes(r.choice(b"abc") for _ in range(r.choice([0, 1, 5, 30]))) for _ in range(r.randint(0, 12))) + r.choice([b"", b"\n"])
        path = tmp_path / f"f{n}"
        path.write_bytes(data)
        want = data.split(b"\n")
        want = want[:-1] if not want[-1] else want
        for size in (1, 2, 7, 1000):
            got = [line for low in range(0, len(data), size) for line in lines_of(str(tmp_path), Split(str(path), low, min(low + size, len(data))))]
            assert got == want


def cell_file(path, rows):
    path.parent.mkdir(exist_ok=True)
    with path.open("a") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in rows)


def test_cells_with_filters_and_odd_lines(spark, tmp_path):
    cell_file(tmp_path / "in" / "a.cells", [("s1", r, c, f"v{r}-{c}") for r in range(1, 200) for c in (1, 2)] + [("s1", "x", 1, "no row number"), ("too", "few")])
    cell_file(tmp_path / "in" / "b.cells", [("s2", 1, 1, "\\N"), ("s2", 2, 1, "tab\\tend\\nback\\\\slash\\x"), ("s2", 3, 1, ""), ("é", 4, 1, "ü")])
    (tmp_path / "in" / "_skipped").write_text("s9\t1\t1\tx\n")
    user_formats.register(spark)
    load = lambda: spark.read.format("cells").options(split=100, push=True).load(str(tmp_path / "in"))
    df = spark.read.format("cells").option("split", 100).load(str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() > 20
    assert df.count() == 402
    assert {r["row_no"]: r["value"] for r in load().where("sheet = 's2'").collect()} == {1: None, 2: "tab\tend\nback\\slash\\x", 3: ""}
    picked = load().where((F.col("sheet") == "s1") & (F.col("row_no") > 197) & F.col("col").isin(1, 3))
    assert sorted(r["value"] for r in picked.collect()) == ["v198-1", "v199-1"]
    assert [r["value"] for r in load().where("sheet like '%é%' and value is not null").collect()] == ["ü"]


def test_pushed_filters_are_asked_in_the_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    cell_file(tmp_path / "in" / "a.cells", [("s1", r, 1, r) for r in range(50)] + [("s2", 1, 1, "x")])
    source = Cells({"path": str(tmp_path / "in"), "push": "true"})
    reader = LineReader(source, source.schema())
    given = [EqualTo(("sheet",), "s1"), GreaterThan(("row_no",), 46), StringContains(("value",), "4")]
    assert list(reader.pushFilters(given)) == given[2:]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_scans_with_different_filters_are_not_one(spark, tmp_path):
    cell_file(tmp_path / "in" / "a.cells", [("s", r, 1, f"v{r}") for r in range(1, 9)])
    user_formats.register(spark)
    df = spark.read.format("cells").load(str(tmp_path / "in"))
    head, rest = df.where("row_no = 1").select("sheet", F.col("value").alias("head")), df.where("row_no > 1")
    assert sorted((r["head"], r["value"]) for r in rest.join(head, "sheet").collect()) == [("v1", f"v{r}") for r in range(2, 9)]


def test_an_empty_folder_and_a_single_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    user_formats.register(spark)
    assert spark.read.format("cells").load(str(tmp_path / "in")).count() == 0
    cell_file(tmp_path / "one.cells", [("s", 1, 1, "x")])
    assert spark.read.format("cells").load(str(tmp_path / "one.cells")).count() == 1
    assert list(files_of(str(tmp_path / "one.cells")).values()) == [8]


def test_a_stream_of_files_that_grow(spark, tmp_path):
    """New files and new whole lines come once, over stops; half a line waits for its end."""
    user_formats.register(spark)
    folder, seen = tmp_path / "in", []

    def go():
        took = []
        rows = spark.readStream.format("cells").load(str(folder))
        stream.run_batches(rows, lambda df, n: took.extend(r["value"] for r in df.collect()), str(tmp_path / "checkpoint"))
        seen.append(sorted(took))

    cell_file(folder / "a.cells", [("s", 1, 1, "one"), ("s", 2, 1, "two")])
    go()
    cell_file(folder / "a.cells", [("s", 3, 1, "three")])
    cell_file(folder / "b.cells", [("s", 1, 1, "other")])
    with (folder / "a.cells").open("a") as f:
        f.write("s\t4\t1\tfo")
    go()
    with (folder / "a.cells").open("a") as f:
        f.write("ur\n")
    go()
    assert seen == [["one", "two"], ["other", "three"], ["four"]]
