"""Landed feeds as a data source: batch and stream, bad files, restarts."""

import os

from veriscope.sources import landed_feeds as L

RSS = "<rss><channel><title>all</title>{}</channel></rss>"
ITEM = "<item><title>T{0} &amp; more</title><link> https://e.org/{0}?utm_source=x </link><description>&lt;b&gt;Text&lt;/b&gt; {0}</description></item>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://e.org/self"/><link href="https://e.org/a"/><summary>Short</summary><content>Long</content></entry></feed>'


def land(folder, name, data, time):
    """A file that is there whole at once, with its time."""
    hidden = folder / ("." + name)
    hidden.write_bytes(data if isinstance(data, bytes) else data.encode())
    os.utime(hidden, (time, time))
    os.rename(hidden, folder / name)


def fill(folder):
    folder.mkdir()
    land(folder, "a.xml", RSS.format("".join(ITEM.format(i) for i in range(3))), 1000)
    land(folder, "b.atom", ATOM, 1001)
    land(folder, "c.rss", "<rss><channel><item>", 1002)
    land(folder, "d.xml", b"\xff\xfe\x00", 1003)
    land(folder, "e.xml", "<html/>", 1004)
    land(folder, "f.rss", RSS.format(""), 1005)
    (folder / "readme.txt").write_text("no feed")
    (folder / "_part.xml").write_text("<rss>")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batch(spark, tmp_path):
    fill(tmp_path / "in")
    items = L.feed_items(spark, str(tmp_path / "in"), taskBytes=1)
    got = plain(L.candidates_of(items, "f"))
    assert got == sorted([(f"https://e.org/{i}", f"T{i} & more", f"Text {i}", "rss", "f") for i in range(3)] + [("https://e.org/a", "A", "Short", "rss", "f")], key=str)
    bad = {os.path.basename(f): r.split(":")[0] for f, r in plain(L.bad_files(items))}
    assert bad == {"c.rss": "no xml", "d.xml": "no xml", "e.xml": "no feed"}
    assert plain(L.feed_items(spark, "file://" + str(tmp_path / "in"))) == plain(items) and items.rdd.getNumPartitions() == 6
    (tmp_path / "none").mkdir()
    assert L.feed_items(spark, str(tmp_path / "none")).count() == 0


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    fill(tmp_path / "in")

    def run():
        s = L.feed_items(spark, str(tmp_path / "in"), stream=True, maxFiles=2)
        s.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        return plain(spark.read.schema(L.SCHEMA).parquet(str(tmp_path / "out")))

    for _ in range(5):  # two files a batch at most, whatever the trigger takes
        first = run()
    assert first == plain(L.feed_items(spark, str(tmp_path / "in")))
    assert run() == first  # a restart without news reads nothing twice
    land(tmp_path / "in", "g.xml", RSS.format(ITEM.format(9)), 2000)
    again = run()
    assert len(again) == len(first) + 1 and again == plain(L.feed_items(spark, str(tmp_path / "in")))


def test_a_file_is_held_item_by_item(tmp_path):
    import subprocess
    import sys

    # items in items, items that hold much, texts outside of items, and a file that breaks at its end
    nested = "<rss>x<item><title>a</title><entry><title>b</title><link>u</link></entry></item>y<item><title>c<i>d</i></title></item></rss>"
    land(tmp_path, "n.xml", nested, 1)
    got = list(L.read_files(str(tmp_path), L.Files([str(tmp_path / "n.xml"), str(tmp_path / "none.xml")])))
    assert [r[1:4] for r in got[:-1]] == [(0, "a", None), (1, "b", "u"), (2, "cd", None)] and got[-1][-1] == "not readable: FileNotFoundError"
    many = "".join(f"<item><title>{i}</title><description>{'word ' * 200}</description></item>" for i in range(60_000))
    land(tmp_path, "big.xml", f"<rss><channel>{many}</channel></rss>", 2)
    land(tmp_path, "torn.xml", f"<rss><channel>{many}</channel>", 3)
    code = f"""
import resource
from veriscope.sources import landed_feeds as L
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
big = sum(r[-1] is None for r in L.read_files({str(tmp_path)!r}, L.Files([{str(tmp_path / "big.xml")!r}])))
torn = [r[-1][:6] for r in L.read_files({str(tmp_path)!r}, L.Files([{str(tmp_path / "torn.xml")!r}]))]
print(big, torn, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split(" [", 1)
    torn, mb = out[1].rsplit("] ", 1)
    assert (out[0], torn) == ("60000", "'no xml'") and float(mb) < 60  # the file has 62 MB
