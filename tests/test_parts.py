"""Parts of bundles: cutting to fit, packing over stretches, rendering, the sink."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheafline.operators import packing
from sheafline.plans import bundle
from sheafline.sources import files, parts


def next_fit(sizes, budget):
    out, part, used = [], 1, 0
    for n in sizes:
        if used and used + n + 2 > budget:
            part, used = part + 1, 0
        used += n + 2
        out.append(part)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_over_many_stretches_equals_a_loop(spark, seed):
    r = random.Random(seed)
    budget = 100
    groups = {"many": [r.choice([0, 1, 5, 40, 98, 97, 60]) for _ in range(3000)], "one": [7], "full": [98] * 200, "tiny": [0] * 2000, "edge": [r.choice([98, 0]) for _ in range(700)]}
    rows = [(g, i, n) for g, sizes in groups.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "bundle_id string, ordinal long, byte_length long").repartition(5)
    got = {(x.bundle_id, x.ordinal): x.part for x in packing.pack(df, budget + packing.RESERVED).collect()}
    assert got == {(g, i): p for g, sizes in groups.items() for i, p in enumerate(next_fit(sizes, budget))}


def test_pieces_fit_with_head_and_fence():
    for text, most, head in [("x" * 50_000, 4096, 100), ("`" * 3000 + "\n" + "y\n" * 4000, 8192, 1900), ("line\n" * 3000, 4096, 3000), ("", 4096, 10), ("é😀" * 4000, 4096, 500)]:
        pieces = packing.fitting(text, most, head)
        assert "".join(pieces) == text and all(head + len(p.encode()) + packing.fence_bytes(p) <= most for p in pieces)
    assert len(packing.fitting("x" * 6000, 4096, 100)) == 3  # 2,048 bytes are left for head and fence
    with pytest.raises(ValueError):
        packing.fitting("text " * 500, 4096, 5000)


def test_only_bodies_that_are_cut_go_to_python(spark, monkeypatch):
    """The cutter in the workers names what it was given; all other bodies are one piece as they are."""
    monkeypatch.setattr(packing, "fitting", lambda text, most, head: ["cut", text[-3:]])
    most = 4096
    bodies = ["", "a\nb", "x" * 2048, "x" * 2049, "é" * 1024 + "z", "`" * 900 + "\n", "`" * 1015, "`" * 1016, None]
    for head in (10, 1009, 2038, 2039):
        df = spark.createDataFrame([("b", i, t, head) for i, t in enumerate(bodies)], "bundle_id string, seq long, body string, head int")
        got = {}
        for r in sorted(packing.fitted_segments(df, most, "head").collect(), key=lambda r: (r.seq, r.segment)):
            got.setdefault(r.seq, []).append(r.content)
        fits = lambda t: len(t.encode()) <= most - 2048 and head + len(t.encode()) + packing.fence_bytes(t) <= most  # noqa: B023, E731
        assert got == {i: [t] if fits(t) else ["cut", t[-3:]] for i, t in enumerate(bodies) if t is not None}


def table(spark, rows):
    return files.from_rows(spark, [("b", i, p, "list", len(c), len(c), None, None, bytearray(c)) for i, (p, c) in enumerate(rows)])


def test_rendered_bundle(spark):
    deep = "/".join(["d" * 190] * 10) + "/long.txt"
    rows = [("src/a.py", b"print(1)\n"), ("src/b_x.md", b"# B\n" + b"word " * 4000), ("10.txt", b"ten"), ("9.txt", b"nine"), (deep, b"z" * 9000), ("x.exe", b"MZ\x90\0")]
    secrets = b"\n".join(b"AKIA%016d" % i for i in range(150))
    out = bundle.run_bundle(table(spark, [*rows, ("many.txt", secrets)]), ["9.*"], max_part=16_384)
    got = sorted(out["parts"].collect(), key=lambda r: r.part)
    assert [r.name for r in got] == [f"b-content.part-{i:03d}.md" for i in range(1, len(got) + 1)] and len(got) > 2
    whole = "".join(r.content for r in got)
    for r in got:
        assert r.byte_length == len(r.content.encode()) <= 16_384
        assert r.content.startswith(f"<!-- part: {r.name} -->\n# b, part {r.part} of {len(got)}\n")
        assert re.findall(r'<a id="([^"]+)"></a>', r.content) == r.anchors
    assert "AKIA" not in whole and whole.count("[REDACTED:cloud-credential]") == 150  # none is left behind a limit
    places = [whole.index(x) for x in ("## About this bundle", "## Tree", "## Index of files", "\n## 10.txt", f"\n## {deep}", "\n## many.txt", "\n## src/a.py")]
    assert places == sorted(places)
    assert "- Files: 7\n- Files included: 5\n- Files excluded: 2" in whole
    assert "- src/\n  - a.py\n  - b\\_x.md\n- 9.txt\n- 10.txt\n" in whole and "- **9.txt**, excluded (excluded-glob)" in whole and "- **x.exe**, excluded (blocked-capability)" in whole
    assert len([a for r in got for a in r.anchors]) == 7 and sum(a.endswith("-segment-002") for r in got for a in r.anchors) == 1
    one = bundle.run_bundle(table(spark, rows[:1]))["parts"].collect()
    assert [r.name for r in one] == ["b-content.md"] and "> This is the only part." in one[0].content
    gone = bundle.run_bundle(table(spark, [("k.txt", b"AKIA" + b"A1" * 8), ("ok.txt", b"fine")]), mode="exclude")["parts"].first().content
    assert "- **k.txt**, excluded (excluded-secret-policy)" in gone and "## k.txt" not in gone and "## ok.txt" in gone


def test_sink_and_source(spark, tmp_path):
    spark.dataSource.register(parts.BundleParts)
    folder = str(tmp_path / "out")
    rows = [(f"b{i % 3}", f"part-{i:03d}.md", f"text é {i}\r\n" * i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "bundle_id string, name string, content string, extra int").repartition(5)
    save = lambda d, mode, to=folder: d.write.format("bundle-parts").mode(mode).save(to)
    read = lambda: {(r.bundle_id, r.name): r.content for r in spark.read.format("bundle-parts").load(folder).collect()}
    save(df, "append")
    want = {(b, n): t for b, n, t, _ in rows}
    assert read() == want and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    assert (tmp_path / "out" / "b1" / "part-004.md").read_bytes() == ("text é 4\r\n" * 4).encode()
    assert spark.read.format("bundle-parts").load(folder).filter(F.sha2("content", 256) != F.col("sha256")).count() == 0
    fails = [df.limit(1), df.limit(1).withColumn("name", F.lit("../up")), df.withColumn("name", F.lit("same")), df.withColumn("content", F.when(F.col("extra") == 17, F.raise_error(F.lit("broken"))).otherwise("x")).withColumn("name", F.concat(F.lit("new"), "extra"))]
    for bad in fails:  # there already, outside, twice, a task that fails: nothing is left of it
        with pytest.raises(Exception):  # noqa: B017
            save(bad, "append")
        assert read() == want and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    save(df.filter("extra < 2"), "overwrite")
    assert read() == {k: v for k, v in want.items() if k[1] < "part-002"}
    save(df.limit(0), "append", str(tmp_path / "empty"))
    assert spark.read.format("bundle-parts").load(str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="content"):
        save(df.drop("content"), "append")


def cut_slowly(text, limit):
    """The same cuts by looking at all that is held whenever a line's first letter comes again."""
    if len(text.encode()) <= limit:
        return [text]
    lines = text.split("\n")
    out, held = [], ""
    for unit in [x for x in [*(f"{line}\n" for line in lines[:-1]), lines[-1]] if x]:
        fits = len(unit.encode()) <= limit
        for piece in [unit] if fits else unit:
            again = not fits and piece == unit[0] and ord(piece) < 256 and (not unit.startswith(held) or held.endswith("\n"))
            if held and (len((held + piece).encode()) > limit or again):
                out, held = [*out, held], ""
            held += piece
    return [*out, held]


def test_pieces_of_long_lines_stay_what_they_were():
    r = random.Random(5)
    for _ in range(4000):
        letters = r.choice(["ab\n", "aé\n", "éa日\n", "a", "日", "ab\r\n", "a\x0b\n", "abc \n\n", "😀a\n", "aaaaaaa\n"])
        text = "".join(r.choice(letters) for _ in range(r.randrange(0, 70))) * r.randrange(1, 4)
        limit = r.randrange(1, 24)
        pieces = packing.split_utf8(text, limit)
        assert pieces == cut_slowly(text, limit) and "".join(pieces) == text


@pytest.mark.parametrize("line", ["a" * 3000, "the data of a table " * 150])
def test_a_long_line_is_not_joined_again_for_each_letter(line):
    import sys

    joins = []
    sys.setprofile(lambda frame, event, arg: joins.append(arg) if event == "c_call" and arg.__name__ == "join" else None)
    try:
        pieces = packing.split_utf8(f"head\n{line}\nend", 2000)
    finally:
        sys.setprofile(None)
    assert "".join(pieces) == f"head\n{line}\nend" and len(joins) <= len(pieces) + 2
