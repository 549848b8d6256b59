"""Raw bodies are put once, whoever writes."""

import threading

import pytest

from claimweave.sources.bodies import Bodies, Store


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(Bodies)
    return f"file://{tmp_path}/bodies"


def write(spark, root, rows):
    spark.createDataFrame(rows, "path string, body binary").write.format("raw_bodies").option("path", root).mode("append").save()


def held(spark, root):
    return {r.path: bytes(r.body) for r in spark.read.format("raw_bodies").option("path", root).load().collect()}


def test_bodies_are_written_and_read(spark, root):
    rows = [(f"raw/a/{i}.html", bytes([i]) * i) for i in range(20)]
    write(spark, root, rows)
    assert held(spark, root) == dict(rows)
    write(spark, root, [("raw/a/3.html", bytes([3]) * 3), ("raw/b/x.html", b"new")])
    assert held(spark, root) == dict(rows) | {"raw/b/x.html": b"new"}


def test_another_body_of_a_path_is_an_error_and_leaves_nothing(spark, root):
    write(spark, root, [("raw/a", b"one")])
    with pytest.raises(Exception, match="raw document of this path exists"):
        write(spark, root, [(f"raw/{i:03}", b"x") for i in range(50)] + [("raw/a", b"two")])
    assert held(spark, root) == {"raw/a": b"one"}
    with pytest.raises(Exception, match="under its root"):
        write(spark, root, [("../out", b"x")])


def test_of_two_writers_one_wins(tmp_path):
    for n in range(20):
        store, start, won = Store(f"file://{tmp_path}/w"), threading.Barrier(4), []

        def put(i, store=store, start=start, won=won, n=n):
            start.wait()
            if store.put(f"p/{n}", b"%d" % i * 1000):
                won.append(i)

        threads = [threading.Thread(target=put, args=(i,)) for i in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and store.get(f"p/{n}") == b"%d" % won[0] * 1000
    assert len(store.names()) == 20 and store.get("none") is None
