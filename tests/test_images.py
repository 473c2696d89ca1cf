"""Tables, searches, edits and sinks over a folder of images of every kind."""

import datetime

import pytest
from pyspark.sql import functions as F

from diskloom.operators import chains, edits, kernel, search, tables
from diskloom.plans.corpus import Corpus, import_changes, reports
from diskloom.sources import images as source
from diskloom.sources.chd import header, hunks
from tests.builders import FILES, body, chd, cpm, floppy, hard_disk


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    bad = bytearray(floppy())
    volume = kernel.volumes(bad, "floppy")[0]
    volume._set(40, 41)
    volume._set(41, 0xFFF)
    volume.flush()
    for name, data in {
        "v.img": floppy(), "bad.dsk": bad, "ibm.ima": floppy("ibm_floppy", "1.44M"), "hd.img": hard_disk(), "cpm.img": cpm(), "boxed.chd": chd(bytes(hard_disk())),
        "broken.chd": chd(bytes(hard_disk()), b"huff"), "short.img": b"x" * 511, "zeros.img": bytes(4096), "other.txt": b"no image",
    }.items():
        (at / name).write_bytes(data)
    return str(at)


@pytest.fixture(scope="module")
def corpus(spark, folder):
    return Corpus.scan(spark, folder)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_types(corpus):
    types = {r["image_id"]: r["image_type"] for r in corpus.images.collect()}
    assert types == {"v.img": "floppy", "bad.dsk": "floppy", "ibm.ima": "ibmpc", "hd.img": "harddisk", "cpm.img": "cpm", "boxed.chd": "harddisk", "broken.chd": "harddisk", "short.img": "floppy", "zeros.img": "floppy"}
    errors = {r["image_id"]: r["error_message"] for r in corpus.images.where("error_code is not null").collect()}
    assert list(errors) == ["broken.chd"] and "huff" in errors["broken.chd"]


def test_every_file_reads_back(corpus):
    got = {(r["image_id"], r["volume_idx"], r["path"]): bytes(r["content"]) for r in corpus.contents.where("error_code is null").collect()}
    for image in ("v.img", "ibm.ima"):
        assert {k[2]: v for k, v in got.items() if k[0] == image and "\\" not in k[2]} == {n: body(n, s) for n, s in FILES.items()}
    for image in ("hd.img", "boxed.chd"):
        assert got[image, 0, "BOOT.SYS"] == got[image, 1, "BOOT.SYS"] == body("BOOT", 3000)
    assert got["cpm.img", 0, "BIG.DAT"][:40000] == body("BIG", 40000)


def test_listing_and_search(corpus):
    listed = [(r["path"], r["attr"], r["size"]) for r in corpus.list().where("image_id = 'v.img'").collect()]
    assert listed[0] == ("D1", "D", 0) and listed[1:] == sorted((n, "A", s) for n, s in FILES.items())
    find = lambda *a, **k: sorted(r["relative"] for r in corpus.find(*a, **k).where("image_id = 'v.img'").collect())
    assert find("*.SYS") == ["CONFIG.SYS", "MSDOS.SYS"] and find("\\d1\\*.*") == ["DEEP.TXT"] and find("readme") == ["README"] and find("D1") == [] and find("nothing") == []
    assert find("*.TXT", recursive=True) == ["D1", "D1\\D2", "D1\\D2\\D3", "D1\\D2\\D3\\DEEP.TXT", "D1\\D2\\DEEP.TXT", "D1\\DEEP.TXT", "EMPTY.TXT"]
    assert find("\\D1\\D2", recursive=True) == ["D3", "D3\\DEEP.TXT", "DEEP.TXT"]
    assert sorted(r["path"] for r in corpus.find("*.*").where("image_id = 'cpm.img'").collect()) == ["BIG.DAT", "HELLO.CMD", "NONE.TXT"]
    sizes = [r["file_size"] for r in search.ordered(corpus.entries.where("image_id = 'v.img' and depth = 0"), "size", False).collect()]
    assert sizes == [0, 5000, 2049, 2048, 500, 0]
    asked = corpus.entries.sparkSession.createDataFrame([("v.img", 0, "/d1/deep.txt"), ("v.img", 0, "none")], "image_id string, volume_idx int, path string")
    assert sorted((r["asked"], r["file_size"]) for r in search.resolve(corpus.entries, asked).collect()) == [("/d1/deep.txt", 700), ("none", None)]


def test_info_and_integrity(corpus):
    info = {(r["image_id"], r["volume_idx"]): r for r in corpus.info().collect()}
    v = info["v.img", 0]
    assert (v["total_clusters"], v["used_clusters"], v["files"], v["directories"], v["physical_clusters"]) == (2378, 7 + 3 + 4, 8, 3, 608)
    assert info["broken.chd", 0]["error_code"] is not None
    total = {r["image_id"]: r for r in corpus.info(rollup=True).where("volume_idx is null").collect()}
    assert total["hd.img"]["files"] == 2
    valid = {r["image_id"]: r["valid"] for r in corpus.valid().collect()}
    assert valid["v.img"] and valid["bad.dsk"] and valid["hd.img"] and not valid["broken.chd"]
    assert [r["code"] for r in corpus.verify().where("image_id = 'bad.dsk'").collect()] == ["V11", "V11"]


def test_native_tables_agree_with_the_kernel(corpus):
    fat = corpus.images.where("image_type <> 'cpm' and error_code is null")
    volumes = tables.volumes(fat)
    same = tables.fat_entries(fat).select("image_id", "volume_idx", "cluster", "next")
    native = tables.native_fat_entries(fat, volumes).select("image_id", "volume_idx", "cluster", "next")
    assert same.exceptAll(native).isEmpty() and native.exceptAll(same).isEmpty()
    columns = ["image_id", "volume_idx", "full_name", "attributes", "first_cluster", "file_size", "modify_date", "modify_time"]
    assert not tables.entries(fat).where("depth = 0 and full_name is not null").select(columns).exceptAll(tables.root_slots(fat, volumes).select(columns)).count()


def test_partitions_and_views(spark, corpus):
    found = corpus.partitions.where("image_id = 'hd.img'").orderBy("index").collect()
    assert [(r["index"], r["label_index"], r["name"], r["letters"]) for r in found] == [(0, 0, "VOL0", ["A:", "C:"]), (1, 2, "VOL2", ["A:", "C:"])]
    corpus.register()
    assert spark.sql("SELECT count(*) FROM entries WHERE image_id = 'v.img' AND is_directory").first()[0] == 3
    assert '"image_id":"v.img"' in reports(corpus.volumes.where("image_id = 'v.img'")).first()["value"]
    assert {r["cluster"] for r in chains.lost(tables.fat_entries(corpus.images.where("image_id = 'bad.dsk'")).withColumnRenamed("image_id", "volume"), spark.createDataFrame([], "volume string, cluster int")).collect()} >= {40, 41}


def test_containers_as_tables(corpus, spark, folder):
    files = spark.read.format("binaryFile").load(folder + "/boxed.chd")
    h = files.select(header(F.col("content")).alias("h")).first()["h"]
    assert (h["version"], h["hunk_bytes"], h["is_compressed"], h["has_parent"], h["hunk_count"]) == (5, 4096, False, False, 625)
    assert hunks(files).count() == 625


def test_edits_make_new_images(spark, corpus):
    when = datetime.datetime(1991, 2, 3, 4, 5, 6)
    schema = "image_id string, volume_idx int, seq int, op string, path string, argument string, content binary"
    changes = spark.createDataFrame([
        ("v.img", 0, 1, "mkdir", "NEW", None, None), ("v.img", 0, 2, "write", "NEW\\A.TXT", None, bytearray(b"hello")), ("v.img", 0, 3, "delete", "NOPE", None, None),
        ("v.img", 0, 4, "attr", "README", "+R -A", None), ("v.img", 0, 5, "rename", "README", "READ.ME", None), ("hd.img", 1, 1, "delete", "BOOT.SYS", None, None), ("hd.img", 7, 2, "delete", "BOOT.SYS", None, None),
        ("cpm.img", 0, 1, "write", "NEW.TXT", "3", bytearray(b"x" * 130)), ("cpm.img", 0, 2, "mkdir", "D", None, None),
    ], schema)
    made = corpus.edit(changes, when)
    errors = {(r["image_id"], x["seq"]): x["error_code"] for r in made.collect() for x in r["results"] if x["error_code"]}
    assert errors == {("v.img", 3): "not_found", ("hd.img", 2): "invalid_partition", ("cpm.img", 2): "unsupported"}
    again = Corpus(made)
    entries = {(r["image_id"], r["path"]): r for r in again.entries.collect()}
    assert entries["v.img", "READ.ME"]["attributes"] == 1 and entries["v.img", "NEW\\A.TXT"]["modify_date"] == 11 << 9 | 2 << 5 | 3
    assert entries["cpm.img", "NEW.TXT"]["user"] == 3 and again.valid().where("not valid").isEmpty()
    assert corpus.entries.where("path = 'READ.ME'").isEmpty()


def test_extract_and_import(spark, corpus, tmp_path):
    out = tmp_path / "out"
    done = corpus.extract("*.*", f"file://{out}", recursive=True).collect()
    assert all(r["error"] is None for r in done) and (out / "v.img/0/D1/D2/DEEP.TXT").read_bytes() == body("DEEP", 1400)
    assert (out / "cpm.img/0/user5/BIG.DAT").stat().st_size == 40064 and (out / "v.img/0/EMPTY.TXT").stat().st_size == 0
    changes = import_changes(source.host_files(spark, str(out / "v.img/0")), "blank.img", target="IN")
    blank = edits.blank_images(spark, [("blank.img", "ibm_floppy", "720K", None)]).withColumn("image_type", F.lit("ibmpc"))
    mkdir = spark.createDataFrame([("blank.img", 0, 0, "mkdir", "IN", None, None)], changes.schema)
    made = Corpus(edits.apply(blank, changes.unionByName(mkdir)))
    assert {r["path"] for r in made.entries.where("not is_directory").collect()} == {"IN\\D1\\DEEP.TXT", "IN\\D1\\D2\\DEEP.TXT", "IN\\D1\\D2\\D3\\DEEP.TXT", "IN\\COMMAND.COM", "IN\\MSDOS.SYS", "IN\\CONFIG.SYS", "IN\\EMPTY.TXT"}
    assert edits.formats(spark).count() == 6


def test_stream_of_images(spark, folder, tmp_path):
    from diskloom.streaming import drop_folder

    running = drop_folder.keep(drop_folder.images(spark, folder), tables.stats, str(tmp_path / "t"), str(tmp_path / "c"), once=True)
    running.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).select("image_id").distinct().count() == 9


def test_command_line(folder, spark, tmp_path, capsys):
    from diskloom.__main__ import main

    assert main(["list", folder, "*.SYS", "--json"]) == 0 and "MSDOS.SYS" in capsys.readouterr().out
    assert main(["verify", folder]) == 1 and main(["info", folder + "/none"]) == 1
    assert main(["create", str(tmp_path / "n.img"), "360K"]) == 0 and (tmp_path / "n.img").stat().st_size == 368640
    assert main(["mkdir", folder, "NEW", "--image", "v.img", "--out", str(tmp_path / "o")]) == 0 and (tmp_path / "o/v.img").exists()
    assert main(["delete", folder, "NO.NE", "--image", "v.img", "--out", str(tmp_path / "o")]) == 1


def test_headers_agree_with_the_kernel(corpus):
    from diskloom.sources import headers

    boot = F.substring("content", 1, 512)
    ibm = corpus.images.where("image_id = 'ibm.ima'").select(headers.parameter_block(boot).alias("b")).first()["b"]
    victor = corpus.images.where("image_id = 'v.img'").select(headers.victor_boot(boot).alias("b")).first()["b"]
    shape = {r["image_id"]: r for r in corpus.volumes.where("volume_idx = 0").collect()}
    for b, v in ((ibm, shape["ibm.ima"]), (victor, shape["v.img"])):
        assert all(b[x] == v[x] for x in ("fat_start", "fat_sectors", "dir_start", "dir_sectors", "data_start", "total_clusters", "sectors_per_cluster"))
    assert ibm["oem_name"] == "MSDOS5.0" and ibm["problem"] is None and victor["double_sided"]
    disk = corpus.images.where("image_id = 'hd.img'").select(headers.physical_label(F.col("content")).alias("b")).first()["b"]
    assert (disk["serial_number"], disk["volume_addresses"]) == ("SERIAL", [8, 1500, 3000])
    labels = headers.volume_labels(corpus.images.where("image_id = 'hd.img'")).orderBy("label_index").collect()
    assert [(r["label"]["name"], r["label"]["kept"], r["label"]["capacity"], len(r["label"]["assignments"])) for r in labels] == [("VOL0", True, 1400, 2), ("VOL1", False, 1400, 2), ("VOL2", True, 1400, 2)]


def test_json_documents(corpus):
    import json

    from diskloom.plans import shapes

    load = lambda df, name: [json.loads(r["value"]) for r in df.where(F.col("image_id") == name).collect()]
    root = next(x for x in load(shapes.listing(corpus.entries), "v.img") if x["path"] == "")
    assert root["status"] == "success" and [f["name"] for f in root["files"]] == ["COMMAND.COM", "MSDOS.SYS", "CONFIG.SYS", "EMPTY.TXT", "README", "D1"]
    assert load(shapes.cpm_listing(corpus.entries), "cpm.img")[0]["files"][1] == {"user": 5, "name": "BIG.DAT", "size": 40064, "is_read_only": False, "is_system": False}
    assert [p["name"] for p in load(shapes.partitions(corpus.images), "hd.img")[0]["partitions"]] == ["VOL0", "VOL2"]
    bad = load(shapes.verification(corpus.images), "bad.dsk")[0]
    assert bad["valid"] and len(bad["warnings"]) == 2 and bad["errors"] == []
    info = load(shapes.information(corpus.images), "v.img")[0]
    assert (info["type"], info["file_count"], info["total_formatted"]) == ("Victor 9000 Floppy", 8, "4.6 MB")


def test_files_are_pasted_between_images(spark, corpus):
    from diskloom.plans.corpus import paste_changes

    changes = paste_changes(corpus.contents.where("image_id = 'cpm.img'"), "ibm.ima", target="D1")
    made = Corpus(corpus.edit(changes))
    pasted = {r["path"]: r["file_size"] for r in made.entries.where("parent = 'D1' and not is_directory").collect()}
    assert pasted == {"D1\\DEEP.TXT": 700, "D1\\BIG.DAT": 40064, "D1\\HELLO.CMD": 384, "D1\\NONE.TXT": 128}


def test_empty_host_files_are_imported(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "full.txt").write_bytes(b"abc")
    (tmp_path / "in" / "deep" / "empty.txt").write_bytes(b"")
    from diskloom.sources.images import host_files

    rows = {r["relative"]: (r["length"], bytes(r["content"])) for r in host_files(spark, str(tmp_path / "in")).collect()}
    assert rows == {"full.txt": (3, b"abc"), "deep/empty.txt": (0, b"")}


def test_a_directory_that_cannot_be_removed_whole_stays_whole(spark):
    from diskloom.operators import edits, kernel

    data = kernel.blank("ibm_floppy", "720K")
    volume = kernel.volumes(data, "ibmpc")[0]
    volume.make_directory(["SUB"], 0, 0)
    for name in ("A.TXT", "B.TXT"):
        volume.write_file(["SUB", name], b"x" * 3000, 0, 0)
    entry = next(e for e in volume.directory(2) if e.full_name == "B.TXT")
    volume._set(entry.first_cluster + 1, entry.first_cluster)
    volume.flush()
    image = spark.createDataFrame([("a", "ibmpc", data)], "image_id string, image_type string, content binary")
    steps = spark.createDataFrame([("a", 0, 1, "rmdir", "SUB", "recursive", None), ("a", 0, 2, "write", "C.TXT", None, bytearray(b"c"))], "image_id string, volume_idx int, seq int, op string, path string, argument string, content binary")
    row = edits.apply(image, steps).collect()[0]
    assert [r["error_code"] for r in row["results"]] == ["corrupted", None]
    after = kernel.volumes(bytes(row["content"]), "ibmpc")[0]
    assert [x[0] for x in after.walk()] == ["SUB", "SUB\\A.TXT", "SUB\\B.TXT", "C.TXT"]
