import gzip

from pyspark.sql import functions as F

from corvine.llm import warc


def differences(a, b):
    out = []
    keys = {(r[0], r[1]) for r in a} | {(r[0], r[1]) for r in b}
    for key in keys:
        x, y = sorted(r[2:] for r in a if r[:2] == key), sorted(r[2:] for r in b if r[:2] == key)
        for n in range(max(len(x), len(y))):
            p, q = x[n] if n < len(x) else None, y[n] if n < len(y) else None
            if p != q:
                out.append((*key, "missing" if q is None else "extra" if p is None else "changed"))
    return sorted(out)


def test_audit(spark):
    schema = "archive long, offset long, length long, digest string"
    left = [(a, o * 3000, 3000, f"{a}-{o}") for a in range(-1, 40) for o in range(60)] + [(3, 10**10, 5, "far"), (3, 0, 3000, "twice")]
    right = [r for r in left if r[:2] not in ((5, 6000), (39, 177000))]
    right = [(*r[:3], "broken") if r[:2] in ((0, 0), (17, 90000), (3, 10**10)) else r for r in right] + [(50, 0, 1, "new"), (-1, 999, 1, "new")]
    found = warc.audit(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted((r.archive, r.offset_right if r.offset_left is None else r.offset_left, r.status) for r in found) == differences(left, right)
    same = spark.createDataFrame(left, schema)
    assert warc.audit(same, same).count() == 0
    assert warc.audit(same.limit(0), same.limit(0)).count() == 0
    assert {r.status for r in warc.audit(same.limit(0), same.limit(3)).collect()} == {"extra"}


def laid_out(records):
    """archive, offset, length, digest of (archive, length, digest) one after the other."""
    ends, out = {}, []
    for archive, length, digest in records:
        out.append((archive, ends.get(archive, 0), length, digest))
        ends[archive] = ends.get(archive, 0) + length
    return out


def test_what_lies_behind_a_loss_is_no_difference(spark):
    schema = "archive long, offset long, length long, digest string"
    whole = [(a, 5000 + 13 * n, f"{a}-{n}") for a in range(3) for n in range(50)]
    damaged = [(a, length + (d == "1-7"), d + "?" * (d in ("1-7", "1-30"))) for a, length, d in whole if d not in ("0-3", "2-10", "2-11")]
    damaged.insert(20, (0, 77, "new"))
    found = warc.audit(spark.createDataFrame(laid_out(whole), schema), spark.createDataFrame(laid_out(damaged), schema)).collect()
    assert sorted((r.digest_left, r.digest_right, r.status) for r in found if r.digest_left) == [("0-3", None, "missing"), ("1-30", "1-30?", "changed"), ("1-7", "1-7?", "changed"), ("2-10", None, "missing"), ("2-11", None, "missing")]
    assert [(r.digest_right, r.status) for r in found if not r.digest_left] == [("new", "extra")]


def test_null_archives_and_offsets(spark):
    schema = "archive long, offset long, length long, digest string"
    left = [(None, 0, 5, "a"), (None, None, 5, "b"), (7, None, 5, "c"), (7, 0, 5, "d"), (-9, 3, 5, "e")]
    right = [(None, 0, 5, "A"), (None, None, 5, "b"), (7, None, 5, "C"), (7, 0, 5, "d"), (-9, 3, 5, "e")]
    found = warc.audit(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted(((r.archive, r.offset_left, r.digest_left, r.digest_right, r.status) for r in found), key=str) == sorted([(None, 0, "a", "A", "changed"), (7, None, "c", "C", "changed")], key=str)


def test_written_files_are_read_again(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    rows = warc.archived(pages, per_archive=20)
    warc.write_warc(rows, f"{tmp_path}/warc")
    read = warc.read_warc(spark, f"{tmp_path}/warc/*").select(F.regexp_extract("path", "archive=([^/]+)", 1).cast("long").alias("archive"), "offset", "length")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.select("archive", "offset", "length").collect()))


def test_records_round_trip(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet").union(spark.createDataFrame([(None, None, None), (7, "http://é", ""), (7, "http://é", "")], "page_id long, url string, html string"))
    rows = warc.archived(pages.withColumn("offset", F.lit("x")), per_archive=20)
    assert rows.count() == pages.count()
    for r in rows.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "record"))).alias("all")).collect():
        content = "".join(x.record for x in r["all"]).encode()
        assert [x.offset for x in r["all"]] == [sum(y.length for y in r["all"][:i]) for i in range(len(r["all"]))]
        (tmp_path / f"{r.archive}.warc").write_bytes(gzip.compress(content) if r.archive % 2 else content)
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(x.body.decode() for x in read) == sorted(r.html or "" for r in pages.collect())
    assert sorted((x.offset, x.length) for x in read) == sorted((x.offset, x.length) for x in rows.collect())
    listed = warc.catalogued(pages, per_archive=20).drop("page_id")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, warc.hashed(rows).collect()))
