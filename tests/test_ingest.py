import gzip
import os

from logevidence.sources.files import discover_log_files, existing_files, read_lines, read_lines_exact


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def rows(df):
    return sorted((r["source_file"], r["line_number"], r["raw"]) for r in df.collect())


def test_plain_gzip_and_bad_bytes(spark, tmpdir_path):
    write(f"{tmpdir_path}/a.log", b"one\ntwo\n\nfour\n")
    write(f"{tmpdir_path}/b.log.gz", gzip.compress(b"g1\ng2\n"))
    write(f"{tmpdir_path}/c.log", b"ok\nbad \xff\xfe bytes\n")
    got = rows(read_lines(spark, tmpdir_path, patterns=("*.log", "*.gz")))
    assert ("a.log", 3, "") in got and ("a.log", 4, "four") in got
    assert [r for r in got if r[0] == "b.log.gz"] == [("b.log.gz", 1, "g1"), ("b.log.gz", 2, "g2")]
    bad = [r for r in got if r[0] == "c.log"]
    assert len(bad) == 2 and "�" in bad[1][2]


def test_flat_vs_recursive_discovery(spark, tmpdir_path):
    write(f"{tmpdir_path}/x.log", b"1\n")
    write(f"{tmpdir_path}/app1/y.log", b"2\n")
    write(f"{tmpdir_path}/app1/y.log-20260101.gz", gzip.compress(b"3\n"))
    flat = [r["name"] for r in discover_log_files(spark, tmpdir_path, ("*.log",)).collect()]
    assert flat == ["x.log"]
    rec = [r["name"] for r in discover_log_files(spark, tmpdir_path, ("*.log", "*.gz"), recursive=True).collect()]
    assert sorted(rec) == ["x.log", "y.log", "y.log-20260101.gz"]


def test_line_numbers_across_many_blocks(spark, tmpdir_path):
    n = 5000
    write(f"{tmpdir_path}/big.log", "".join(f"line {i}\n" for i in range(1, n + 1)).encode())
    write(f"{tmpdir_path}/small.log", b"s1\ns2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, tmpdir_path)
        assert df.rdd.getNumPartitions() > 8
        got = rows(df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = [r for r in got if r[0] == "big.log"]
    assert len(big) == n
    assert all(raw == f"line {ln}" for _, ln, raw in big)
    assert [r for r in got if r[0] == "small.log"] == [("small.log", 1, "s1"), ("small.log", 2, "s2")]


def test_exact_mode_splitlines(spark, tmpdir_path):
    text = "a\r\nb\x0bc d\n\ne\n"
    write(f"{tmpdir_path}/e.log", text.encode("utf-8"))
    write(f"{tmpdir_path}/z.log.gz", gzip.compress("p\rq".encode()))
    got = rows(read_lines_exact(spark, tmpdir_path, patterns=("*.log", "*.gz")))
    e = [r[2] for r in got if r[0] == "e.log"]
    assert e == text.splitlines()
    assert [r[2] for r in got if r[0] == "z.log.gz"] == ["p", "q"]
    write(f"{tmpdir_path}/l1.log", "café\n".encode("latin-1"))
    got = rows(read_lines_exact(spark, [f"{tmpdir_path}/l1.log"], encoding="ISO-8859-1"))
    assert got == [("l1.log", 1, "café")]


def test_explicit_list_reports_missing(spark, tmpdir_path):
    write(f"{tmpdir_path}/a.log", b"x\n")
    present, missing = existing_files(spark, [f"{tmpdir_path}/a.log", f"{tmpdir_path}/nope.log"])
    assert present == [f"{tmpdir_path}/a.log"] and missing == [f"{tmpdir_path}/nope.log"]


def test_line_numbers_over_small_splits(spark, tmpdir_path):
    n = 3000
    write(f"{tmpdir_path}/big.log", "".join(f"row {i}\n" for i in range(1, n + 1)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = rows(read_lines(spark, tmpdir_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == n and all(raw == f"row {ln}" for _, ln, raw in got)


HAPROXY = ("Feb  6 12:14:14 localhost haproxy[14389]: 10.0.1.2:33317 [06/Feb/2009:12:14:14.655] http-in static/srv1 "
           '10/0/30/69/109 200 2750 - - ---- 1/1/1/1/0 0/0 {1wt.eu} {} "GET /%s HTTP/1.1"')


def test_any_file_name_encoding_and_folder(spark, tmpdir_path):
    """Names with spaces, hashes and brackets, a folder named like a log, Latin-1 and bad UTF-8 bytes."""
    from logevidence.config import Params
    from logevidence.plans.jobs import classify_files

    for i, name in enumerate(("web site.log", "web#1.log", "web[1].log", "web%20x.log", "web{a}.log")):
        write(f"{tmpdir_path}/in/{name}", (HAPROXY % f"p{i}").encode() + b"\n")
    write(f"{tmpdir_path}/in/old.log/inner.txt", b"not a log\n")
    write(f"{tmpdir_path}/in/u_ex1.log", b"#Fields: date time cs-method cs-uri-stem sc-status\n2026-01-01 00:00:00 GET /i 200\n")
    got = classify_files(spark, f"{tmpdir_path}/in").where("status = 'ok'").select("source_file", "path", "source").collect()
    assert sorted(r["path"] for r in got) == ["/i", "/p0", "/p1", "/p2", "/p3", "/p4"]
    assert {r["source"] for r in got if r["path"] == "/i"} == {"iis"}
    assert {r["source_file"] for r in got} >= {"web site.log", "web#1.log", "web[1].log", "web%20x.log", "web{a}.log"}
    write(f"{tmpdir_path}/latin/x.log", (HAPROXY % "café").encode("latin-1") + b"\n")
    latin = classify_files(spark, f"{tmpdir_path}/latin", Params(encoding="latin-1")).collect()
    assert [r["path"] for r in latin] == ["/café"]
    write(f"{tmpdir_path}/cp/x.log", (HAPROXY % "šč").encode("cp1250") + b"\n")
    assert [r["path"] for r in classify_files(spark, f"{tmpdir_path}/cp", Params(encoding="cp1250")).collect()] == ["/šč"]
    bad = classify_files(spark, f"{tmpdir_path}/latin").collect()
    assert "\ufffd" in bad[0]["raw"]


def test_hidden_names_are_refused(spark, tmpdir_path):
    import pytest

    from logevidence.plans.jobs import classify_files

    write(f"{tmpdir_path}/a.log", b"x\n")
    write(f"{tmpdir_path}/_access.log", b"x\n")
    with pytest.raises(ValueError, match="_access.log"):
        classify_files(spark, tmpdir_path)


def test_control_characters_stay_in_their_field(spark, tmpdir_path):
    from logevidence.operators.haproxy import haproxy_events
    from helpers import lines_df

    line = HAPROXY.replace("static/srv1", "sta\x01tic/s\x02rv1") % "a\x01b"
    r = haproxy_events(lines_df(spark, [line])).first()
    assert (r["status"], r["backend"], r["path"], r["method"], r["status_code"]) == ("ok", "sta\x01tic/s\x02rv1", "/a\x01b", "GET", 200)


def test_files_in_hidden_folders_are_refused(spark, tmpdir_path):
    """Each file is read by Spark or makes discovery an error, whatever its own or its folders' names."""
    names = ["in/_old/x.log", "in/.old/x.log", "in/app/_old/deep/x.log", "_x.log", "app/.x.log", "_metadata.log", "x._COPYING_/x.log",
             "_a=b.log", "_a=b/x.log", "_metadata/x.log", "app/x.log", "x.log"]
    for i, name in enumerate(names):
        root = f"{tmpdir_path}/_{i}"
        write(f"{root}/{name}", b"1\n")
        write(f"{root}/_old/note.txt", b"1\n")  # matches no pattern
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(root).count()
        try:
            found = [r["name"] for r in discover_log_files(spark, root, recursive=True).collect()]
        except ValueError as e:
            assert read == 0 and "does not read" in str(e) and name.rsplit("/", 1)[-1] in str(e), name
        else:
            assert read == 1 and found == [name.rsplit("/", 1)[-1]], name
    write(f"{tmpdir_path}/flat/_old/x.log", b"1\n")
    write(f"{tmpdir_path}/flat/y.log", b"1\n")
    assert [r["name"] for r in discover_log_files(spark, f"{tmpdir_path}/flat").collect()] == ["y.log"]


BOUNDARIES = "\r \x0b \x0c \x1c \x1d \x1e \x85 \u2028 \u2029".split(" ")


def _odd_text(rng, lines):
    pieces = []
    for i in range(lines):
        pieces.append("word" * rng.randrange(3) + str(i))
        pieces.append(rng.choice(["\n"] * 6 + ["\r\n", "\r\r\n", "\n\n", *BOUNDARIES, "\x0b\n", "\u2028\r\n"]))
    return "".join(pieces)


def test_lines_equal_splitlines_over_several_blocks(spark, tmpdir_path):
    import random

    rng = random.Random(8)
    texts = {"many.log": _odd_text(rng, 6_000), "plain.log": "a\nb", "bom.log": "\ufeffa\x0b", "empty.log": ""}
    for k, end in enumerate(["", "\n", "\r", "\r\n", "\x0b", "\x0b\n", "\x85\r", "\x0b\x0b", "\u2029\r\n", "\r\r"]):
        texts[f"end{k}.log"] = "first\nlast" + end
    for name, text in texts.items():
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(text.encode())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_lines(spark, tmpdir_path)
        found = {}
        for r in got.collect():
            found.setdefault(r.source_file, []).append((r.line_number, r.raw))
        blocks = got.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert blocks > 1 and len(texts["many.log"]) > 5 * 4096
    for name, text in texts.items():
        lines = text.removeprefix("\ufeff").splitlines()
        assert sorted(found.get(name, [])) == list(enumerate(lines, 1)), name


def test_latin_lines(spark, tmpdir_path):
    with open(f"{tmpdir_path}/latin.log", "wb") as f:
        f.write("caf\u00e9\x85two\n\u00fc\x85".encode("latin-1"))
    rows_ = read_lines(spark, tmpdir_path, encoding="latin-1").orderBy("line_number").collect()
    assert [r.raw for r in rows_] == "caf\u00e9\x85two\n\u00fc\x85".splitlines()
