import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.operators import table
from skyweft.plans import saved_index, solve
from skyweft.sources import fits, packed, text
from skyweft.streaming import jobs


def test_binary_table_round_trip(spark, tmp_path):
    cols = [("ra", "double"), ("n", "int"), ("big", "long"), ("ok", "boolean"), ("name", "string"), ("v", "array<float>")]
    rows = [(i / 7, -i, i << 40, i % 3 == 0, f"s{i}", [i + 0.5, i - 0.25]) for i in range(2500)]
    path = tmp_path / "t.fits"
    path.write_bytes(fits.encode_table(cols, rows))
    fits.register(spark)
    df = spark.read.format("skytable").option("rows", 600).load(str(path))
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect()), key=lambda r: -r[1]) == rows
    files = spark.read.format("binaryFile").load(str(path))
    assert fits.tables_from_binary(files, path.read_bytes()).count() == 2500


def test_delimited_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# comment\n1 0x1F 2.5 a\n2 7 nan b\nbad line\n\n3 -0x2 1e3 c\n")
    df, dropped = text.read_delimited(spark, str(tmp_path / "t.txt"), ["i", "h", "f", "s"])
    rows = df.orderBy("i").collect()
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "string"]
    assert [r.h for r in rows] == [31, 7, -2] and np.isnan(rows[1].f) and dropped.first()["dropped"] == 1


def test_struct_text(spark, tmp_path):
    (tmp_path / "t.par").write_text('typedef enum {\n A,\n B\n} KIND;\ntypedef struct {\n double mag[3];\n char name[20];\n int n;\n KIND k;\n} STAR;\nkey some value\nSTAR {1.5 2.5 3.5} "two words" 7 A\nstar { 4 5 6 } one \\\n 8 B # tail\n')
    df = text.read_struct_text(spark, str(tmp_path / "t.par"), "STAR")
    assert sorted(map(tuple, df.collect())) == [([1.5, 2.5, 3.5], "two words", 7, "A"), ([4.0, 5.0, 6.0], "one", 8, "B")]


def test_fixed_width(spark, tmp_path):
    (tmp_path / "c.dat").write_text("0001 12.50 abc\n0002    \\N def\n")
    df = text.read_fixed_width(spark, str(tmp_path / "c.dat"), {"id": (1, 4, "int"), "mag": (5, 6, "double"), "name": (12, 3, "string")})
    assert sorted(map(tuple, df.collect())) == [(1, 12.5, "abc"), (2, None, "def")]


def test_packed_records(spark, tmp_path):
    import struct

    (tmp_path / "p.bin").write_bytes(b"".join(struct.pack("<ihf", i, -i, i / 2) + b"\0\0" for i in range(5)))
    files = spark.read.format("binaryFile").load(str(tmp_path / "p.bin"))
    got = packed.read_records(spark, str(tmp_path / "p*"), [("a", "i"), ("b", "h"), ("c", "f")], 12)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(i, i, -i, i / 2) for i in range(5)]


def test_solved_stays_solved(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, False), (2, True)], [(1, True), (2, False), (3, False)]):
        spark.createDataFrame(rows, "field long, solved boolean").coalesce(1).write.mode("append").parquet(src)
    q = jobs.solved_state(jobs.job_stream(spark, src, "field long, solved boolean", 1)).writeStream.outputMode("update").foreachBatch(lambda d, i: d.withColumn("i", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("field").agg(F.max_by("solved", "i").alias("s"), F.max("tries").alias("t")).collect()
    assert {r.field: (r.s, r.t) for r in last} == {1: (True, 2), 2: (True, 2), 3: (False, 1)}


def test_solved_state_is_kept_by_sparks_own_aggregation(spark):
    rows = spark.createDataFrame([(1, False), (1, None), (1, True), (1, False), (2, None)], "f long, ok boolean")
    out = jobs.solved_state(rows, "f", "ok")
    assert {tuple(r) for r in out.collect()} == {(1, True, 3), (2, False, 1)}
    assert out.schema.simpleString() == "struct<field:bigint,solved:boolean,tries:int>"
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_depth_batches_stop_at_the_first_success(spark):
    f = spark.createDataFrame([(k, r) for k in (1, 2) for r in range(30)], "field long, rank int")
    found = jobs.depth_batches(f, [(1, 10), (11, 20), (21, 30)], lambda df: df.groupBy("field").agg(F.count(F.lit(1)).alias("n")).where("n >= 10 * field").select("field"))
    assert {r.field: r.depth for r in found.collect()} == {1: 10, 2: 20}


@pytest.mark.parametrize("mode,want", [("best", {1: 30.0}), ("first", {1: 20.0})])
def test_agreeing(spark, mode, want):
    m = spark.createDataFrame([(1, 5.0, 9, 0), (1, 20.0, 9, 1), (1, 30.0, 9, 2), (2, 50.0, 1, 0)], "field long, odds double, n int, o int")
    assert {r.field: r.odds for r in solve.agreeing(m, "field", "odds", "n", "o", 10.0, 5, mode).collect()} == want
    assert {r.field for r in solve.leftovers(m, "field", "odds", "n", 10.0, 5).collect()} == {2}


def test_skipped_lines(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("x y z\n9 9 9\n1 2 3\n4 5 6\n")
    df, dropped = text.read_delimited(spark, str(tmp_path), ["i", "j", "k"], skip=2)
    assert sorted(map(tuple, df.collect())) == [(1, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 6)] and dropped.first()["dropped"] == 0
    assert text.read_delimited(spark, str(tmp_path), ["i", "j", "k"], skip=9)[0].count() == 0


def test_struct_text_is_written_and_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", [1.5, 2.5]), (2, "c", [3.0, 4.0])], "n int, name string, mag array<double>")
    out = str(tmp_path / "s")
    text.write_struct_text(df, out, "star")
    text.write_struct_text(df.withColumn("n", F.col("n") + 10), out, "star", "append")
    assert sorted(map(tuple, text.read_struct_text(spark, out, "STAR").collect())) == [(1, "a b", [1.5, 2.5]), (2, "c", [3.0, 4.0]), (11, "a b", [1.5, 2.5]), (12, "c", [3.0, 4.0])]


def test_tables_are_written_by_tasks_appended_and_replaced(spark, tmp_path):
    fits.register(spark)
    df = spark.range(25_000).selectExpr("id", "id / 7.0D AS ra", "cast(id % 3 = 0 as boolean) AS ok", "concat('s', id) AS name", "array(cast(id as float), 0.5f) AS v").repartition(3)
    out = str(tmp_path / "t")
    df.write.format("skytable").option("arrays", 2).mode("append").save(out)
    df.where("id < 5").selectExpr("id + 100000 AS id", "ra", "ok", "name", "v").write.format("skytable").option("arrays", 2).mode("append").save(out)
    back = spark.read.format("skytable").load(out)
    assert back.count() == 25_005 and back.where("id < 25000").exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    df.where("id = 1").write.format("skytable").option("arrays", 2).mode("overwrite").save(out)
    assert [r.id for r in spark.read.format("skytable").load(out).collect()] == [1]
    with pytest.raises(Exception, match="longer than 2"):
        df.where("id = 1000").write.format("skytable").option("arrays", 2).option("strings", 2).mode("append").save(out)
    assert spark.read.format("skytable").load(out).count() == 1


def test_images_are_read_by_rows(spark, tmp_path):
    fits.register(spark)
    image = np.arange(600.0).reshape(20, 30)
    image[3, 4] = np.nan
    (tmp_path / "i.fits").write_bytes(fits.encode_image(image))
    df = spark.read.format("skyimage").option("rows", 7).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    got = {(r.x, r.y): r.value for r in df.collect()}
    assert got == {(x, y): image[y, x] for x in range(30) for y in range(20) if not np.isnan(image[y, x])}


def test_usnob_records_are_taken_apart(spark, tmp_path):
    """Digits put together by hand in every word, files cut into ranges of records."""
    r, want, files = np.random.default_rng(1), {}, []
    n = lambda hi: int(r.integers(0, hi))
    for k in range(3):
        raw = []
        for i in range(50 + k):
            ra, spd, det, spike = n(129_600_000), n(64_800_000), n(6), n(2)
            pm, spm, prob, moving = n(10_000), n(10_000), n(10), n(2)
            e = (n(1000), n(1000), n(10), n(10))
            s = (n(1000), n(1000), n(1000), n(2))
            obs = [(n(10_000), n(938) if n(4) else 0, n(10), n(12), n(10_000), n(10_000), n(10), n(10_000_000)) for _ in range(5)]
            w = [ra, spd, pm + spm * 10**4 + prob * 10**8 + moving * 10**9, e[0] + e[1] * 1000 + e[2] * 10**6 + e[3] * 10**7 + det * 10**8 + spike * 10**9, s[0] + s[1] * 1000 + s[2] * 10**6 + s[3] * 10**9]
            w += [m + f * 10**4 + v * 10**7 + g * 10**8 for m, f, v, g, *_ in obs] + [x + y * 10**4 + c * 10**8 for *_, x, y, c, _ in obs] + [o[-1] for o in obs]
            raw.append(w)
            residual = lambda o, at, d=det: 0.0 if d >= 2 and o[1] == 0 else (o[at] - 5000) * 0.01 / 3600
            want[k, i] = [ra / 360_000, spd / 360_000 - 90, 0.002 * (pm - 5000), 0.002 * (spm - 5000), 0.1 * prob, moving, 0.001 * e[0], 0.001 * e[1], 0.1 * e[2] / 3600, 0.1 * e[3] / 3600, det, spike, 0.001 * s[0] / 3600, 0.001 * s[1] / 3600, 1950 + 0.1 * s[2], s[3]]
            want[k, i] += [v for o in obs for v in (0.01 * o[0], o[1], o[2], o[3], residual(o, 4), residual(o, 5), o[6], o[7])]
        files.append(tmp_path / f"b{k}.cat")
        files[-1].write_bytes(np.array(raw, "<u4").tobytes())
    df = packed.read_usnob(spark, str(tmp_path), records=20)
    assert df.rdd.getNumPartitions() == 9
    rows = df.collect()
    assert len(rows) == len(want)
    for x in rows:
        flat = [float(v) for c in x[2:-1] for v in [c]] + [float(v) for o in x.obs for v in o]
        assert np.allclose(flat, [float(v) for v in want[int(x.file[-5]), x.row]], atol=1e-9)


@pytest.mark.parametrize("layout, record", [(packed.UCAC3, packed.UCAC3_RECORD), (packed.UCAC4, packed.UCAC4_RECORD)])
def test_ucac_records_there_and_back(spark, tmp_path, layout, record):
    fields = packed.layout_of(layout)
    assert packed.Layout(tuple(fields), record).dtype().itemsize == record == sum(np.dtype(packed.CODES[c][0]).itemsize for _, c in fields)
    r = np.random.default_rng(2)
    raw = np.zeros(230, np.dtype([(n, packed.CODES[c][0]) for n, c in fields]))
    for n in raw.dtype.names:
        info = np.iinfo(raw.dtype[n])
        raw[n] = r.integers(info.min, info.max, len(raw), dtype=np.int64, endpoint=True)
    (tmp_path / "z001").write_bytes(raw.tobytes())
    read = packed.read_ucac3 if record == packed.UCAC3_RECORD else packed.read_ucac4
    rows = sorted(read(spark, str(tmp_path), records=100).collect(), key=lambda x: x.row)
    assert [x.row for x in rows] == list(range(230))
    for name, _, factor, offset in layout:
        assert np.allclose([float(x[name]) for x in rows], raw[name].astype(float) * factor + offset, atol=1e-9)
    plain = packed.read_records(spark, str(tmp_path), fields, record)
    packed.write_records(plain.drop("file", "row").repartition(3), str(tmp_path / "out"), fields, record)
    again = packed.read_records(spark, str(tmp_path / "out"), fields, record, 7).drop("file", "row")
    assert again.exceptAll(plain.drop("file", "row")).isEmpty() and again.count() == 230


def test_records_that_can_not_be_read_or_written(spark, tmp_path):
    (tmp_path / "cut").write_bytes(b"123456789")
    with pytest.raises(Exception, match="within a record"):
        packed.read_records(spark, str(tmp_path / "cut"), [("a", "i")]).collect()
    for bad, why in (("null", "null"), ("300", "does not fit")):
        with pytest.raises(Exception, match=why):
            packed.write_records(spark.sql(f"SELECT cast({bad} as int) AS a"), str(tmp_path / "bad"), [("a", "B")])
    assert list((tmp_path / "bad").iterdir()) == []
    packed.write_records(spark.range(5).selectExpr("cast(id as int) AS a").repartition(9), str(tmp_path / "o"), [("_", "h"), ("a", "B")], 4)
    assert sorted(x.a for x in packed.read_records(spark, str(tmp_path / "o"), [("_", "h"), ("a", "B")], 4).collect()) == [0, 1, 2, 3, 4]
    packed.write_records(spark.range(2).selectExpr("cast(id + 7 as int) AS a"), str(tmp_path / "o"), [("_", "h"), ("a", "B")], 4, "overwrite")
    assert sorted(x.a for x in packed.read_records(spark, str(tmp_path / "o"), [("_", "h"), ("a", "B")], 4).collect()) == [7, 8]


@pytest.mark.parametrize("n", [0, 1, 9_999, 10_000, 10_001, 20_000])
def test_tables_of_full_steps_and_of_nothing(spark, tmp_path, n):
    fits.register(spark)
    spark.range(n).selectExpr("id", "concat('s', id) AS name", "id > 3 AS ok").coalesce(1).write.format("skytable").mode("append").save(str(tmp_path / "t"))
    assert sorted(x.id for x in spark.read.format("skytable").load(str(tmp_path / "t")).collect()) == list(range(n))


def test_rows_keep_where_they_come_from(spark, tmp_path):
    fits.register(spark)
    for name in "ab":
        rows = [(i, f"{name}{i}") for i in range(1500)]
        (tmp_path / f"{name}.fits").write_bytes(fits.encode_table([("n", "int"), ("name", "string")], rows))
    df = spark.read.format("skytable").option("provenance", "true").option("rows", 400).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 8
    assert all(x.name == f"{x.backref_file[-6]}{x.backref_index}" for x in df.repartition(5).collect())
    saved_index.write_tiles(df.withColumn("tile", F.col("n") % 7), str(tmp_path / "tiles"))
    tiles = spark.read.parquet(str(tmp_path / "tiles"))
    assert tiles.count() == 3000 and all(x.name == f"{x.backref_file[-6]}{x.backref_index}" for x in tiles.collect())
    with pytest.raises(ValueError, match="backref_index"):
        saved_index.write_tiles(df.drop("backref_index"), str(tmp_path / "no"))
    a = str(tmp_path / "a.fits")
    wanted = spark.createDataFrame([(a, 7, 0), (a, 3, 1), (a, 7, 2), (a, 99_999, 3), ("gone", 1, 4)], "backref_file string, backref_index long, place int")
    assert [(x.place, x.name) for x in saved_index.copied_rows(df, wanted).orderBy("place").collect()] == [(0, "a7"), (1, "a3"), (2, "a7")]


def test_a_file_a_row_with_headers_and_tables(spark, tmp_path):
    fits.register(spark)
    out = str(tmp_path / "f")
    row = "name string, header map<string, string>, stars array<struct<id: bigint, label: string>>, pairs array<struct<a: int, b: double>>"
    df = spark.createDataFrame([("one", {"OBJECT": "it's one", "EXPTIME": "1.5", "SOLVED": "T"}, [(1, "x"), (2, "long name")], [(1, 0.5)]), ("two", None, None, []), ("three", {"a": "b"}, [(9, None)], [(3, 1.0), (4, 2.0)])], row)
    df.repartition(4).write.format("skyfiles").mode("append").save(out)
    read = lambda ext: sorted((x.backref_file.rsplit("/", 1)[1], *x[:2]) for x in spark.read.format("skytable").option("ext", ext).option("provenance", "true").load(out).collect())
    assert read(1) == [("one.fits", 1, "x"), ("one.fits", 2, "long name"), ("three.fits", 9, "")]
    assert read(2) == [("one.fits", 1, 0.5), ("three.fits", 3, 1.0), ("three.fits", 4, 2.0)]
    cards = {(x.file.rsplit("/", 1)[1], x.extension, x.name): x.value for x in spark.read.format("skyheader").load(out).collect()}
    assert cards["one.fits", 0, "OBJECT"] == "it's one" and cards["one.fits", 0, "SOLVED"] == "T" and cards["three.fits", 2, "EXTNAME"] == "pairs" and cards["three.fits", 0, "A"] == "b"
    df.where("name = 'two'").write.format("skyfiles").mode("overwrite").save(out)
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["two.fits"] and read(1) == []
    with pytest.raises(Exception, match="too long"):
        spark.createDataFrame([("x", {"A": "v" * 90}, [], [])], row).write.format("skyfiles").mode("append").save(out)
    assert read(1) == []


def test_struct_text_of_many_definitions(spark, tmp_path):
    """More files and tables than any bound on headers would allow; a table that files define differently is refused."""
    for i in range(130):
        (tmp_path / f"{i}.par").write_text(f"typedef enum {{\n A,\n B\n}} KIND{i};\ntypedef struct {{\n int n;\n KIND{i} k;\n}} T{i};\ntypedef struct {{\n int n;\n}} SAME;\nT{i} {i} A\nSAME {i}\n")
    assert [tuple(x) for x in text.read_struct_text(spark, str(tmp_path), "t129").collect()] == [(129, "A")]
    assert text.read_struct_text(spark, str(tmp_path), "SAME").count() == 130
    (tmp_path / "z.par").write_text("typedef struct {\n double n;\n} SAME;\nSAME 1.5\n")
    with pytest.raises(ValueError, match="differently"):
        text.read_struct_text(spark, str(tmp_path), "SAME")
    with pytest.raises(ValueError, match="no file"):
        text.read_struct_text(spark, str(tmp_path), "NONE")


def test_images_are_written_by_tasks(spark, tmp_path):
    fits.register(spark)
    r = np.random.default_rng(3)
    want = {(k, x, y): float(r.normal()) for k in range(7) for y in range(3 + k) for x in range(9 - k) if r.random() < 0.8 or (x, y) == (8 - k, 2 + k)}
    df = spark.createDataFrame([(*k, v) for k, v in want.items()], "image long, x long, y long, value double").repartition(5)
    fits.write_images(df, str(tmp_path / "i"))
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == [f"image-{k}.fits" for k in range(7)]
    got = spark.read.format("skyimage").option("rows", 2).load(str(tmp_path / "i"))
    assert {(x.image, x.x, x.y): x.value for x in got.collect()} == want
    with pytest.raises(Exception, match="not together|several"):
        df.withColumn("width", F.lit(9)).withColumn("height", F.lit(9)).orderBy("y", "image", "x").write.format("skyimage").mode("append").save(str(tmp_path / "j"))
    assert list((tmp_path / "j").iterdir()) == []
    fits.write_images(df.where("image = 3"), str(tmp_path / "i"), "overwrite")
    assert [p.name for p in (tmp_path / "i").iterdir()] == ["image-3.fits"]


def test_quoted_texts_in_filters_stay(spark):
    df = spark.createDataFrame([(1, "a!b"), (2, "a && b"), (3, "x==y"), (4, None)], "id int, name string")
    ids = lambda e: sorted(x.id for x in table.filter_rows(df, e).collect())
    assert ids("name == 'a!b'") == [1] and ids("name == 'a && b' || name == 'x==y'") == [2, 3] and ids("!(id > 2) && name != 'a!b'") == [2]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """a folder of files is read by a few tasks that open the headers themselves."""
    from pyspark.sql import functions as F

    fits.register(spark)
    rows = spark.range(300).select(F.format_string("f-%03d", "id").alias("name"), F.create_map(F.lit("N"), F.col("id").cast("string")).alias("header"), F.array(F.struct("id", (F.col("id") * 2).alias("v"))).alias("stars"))
    rows.write.format("skyfiles").mode("append").save(str(tmp_path))
    table = spark.read.format("skytable").option("provenance", "true").load(str(tmp_path))
    cards = spark.read.format("skyheader").load(str(tmp_path)).where("name = 'N'")
    assert table.rdd.getNumPartitions() == 1 and spark.read.format("skyheader").load(str(tmp_path)).rdd.getNumPartitions() == 1
    assert sorted((r["id"], r["v"], r["backref_index"], r["backref_file"][-10:]) for r in table.collect()) == [(i, 2 * i, 0, f"f-{i:03d}.fits") for i in range(300)]
    assert sorted(int(r["value"]) for r in cards.collect()) == list(range(300))
    by_range = spark.read.format("skytable").option("rows", 1).load(str(tmp_path))
    assert by_range.rdd.getNumPartitions() == 300 and by_range.count() == 300


def test_a_tile_is_the_work_of_several_tasks(spark, tmp_path):
    """a large tile is dealt to several tasks, a file each."""
    rows = spark.range(2000).selectExpr("id", "1 AS tile", "'f' AS backref_file", "id AS backref_index")
    saved_index.write_tiles(rows, str(tmp_path / "tiles"))
    assert len(list((tmp_path / "tiles" / "tile=1").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 2000
