"""Files as rows: limits, broken and short ones, streams, and loads that know what is there."""

from lodestone.sources.files import file_stream, files, load_files, load_new_files
from lodestone.sources.stored import Stored


def put(folder, name, data):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)


def names(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}


def test_batch(spark, tmp_path):
    for name, data in {"b.txt": b"two", "a.txt": "é one".encode(), "c.md": b"no", "sub/d.txt": b"\xff\xfe", "e.txt": b"", "f.txt": b"a\r\nb\n"}.items():
        put(tmp_path, name, data)
    got = names(files(spark, str(tmp_path)))
    assert {n: (r.text, r.broken, r.size) for n, r in got.items()} == {"a.txt": ("é one", False, 6), "b.txt": ("two", False, 3), "d.txt": (None, True, 2), "f.txt": ("a\r\nb\n", False, 5)}
    assert set(names(files(spark, str(tmp_path), limit=2))) == {"a.txt", "b.txt"} and set(names(files(spark, str(tmp_path), limit=9))) == set(got)
    assert set(names(files(spark, str(tmp_path), least_bytes=3))) == {"a.txt", "b.txt", "f.txt"} and files(spark, str(tmp_path), "*.x", limit=3).count() == 0
    table = Stored(spark, f"{tmp_path}/table", "path", buckets=4)
    assert load_files(files(spark, str(tmp_path)), table, least_chars=3) == {"found": 4, "errors": 1, "inserted": 3, "skipped": 0}
    put(tmp_path, "g.txt", b"new one")
    assert load_files(files(spark, str(tmp_path)), table, least_chars=3) == {"found": 5, "errors": 1, "inserted": 1, "skipped": 3}
    assert set(names(table.read())) == {"a.txt", "b.txt", "f.txt", "g.txt"}


def test_stream(spark, tmp_path):
    folder, table = tmp_path / "in", Stored(spark, f"{tmp_path}/table", "path", buckets=4)
    for k in range(5):
        put(folder, f"{k}.txt", b"text %d" % k)
    put(folder, "x.txt", b"\xff")
    assert load_new_files(file_stream(spark, str(folder), at_once=2), table, f"{tmp_path}/state") == {"found": 6, "errors": 1, "inserted": 5, "skipped": 0}
    put(folder, "6.txt", b"later")
    assert load_new_files(file_stream(spark, str(folder), at_once=2), table, f"{tmp_path}/state") == {"found": 1, "errors": 0, "inserted": 1, "skipped": 0}
    assert table.read().count() == 6
    # a lost checkpoint brings all of them again, and none comes in twice
    assert load_new_files(file_stream(spark, str(folder)), table, f"{tmp_path}/other") == {"found": 7, "errors": 1, "inserted": 0, "skipped": 6}
