"""Cells nested to any depth, read by blocks, against a tree parser."""

import random
import xml.etree.ElementTree as ET

from trackspark.sources.io import read_lineage_xml


def by_tree(path):
    """Frame rows and divisions by walking the parsed tree."""
    frames, divisions = [], []
    for f in ET.parse(path).getroot().iter("f"):
        field = int(f.get("id")) if f.get("id") else None
        for top in f.findall("as"):
            for a in top.findall(".//a"):
                for ss in a.findall("ss"):
                    for s in ss.findall("s"):
                        frames.append((field, int(a.get("id")), a.get("brush"), a.get("type"), int(s.get("i")), float(s.get("x")), float(s.get("y")), int(s.get("s"))))
                lists = a.findall("as")
                if lists:
                    two = len(lists[0].findall("a")) == 2
                    divisions.append((field, int(a.get("id")), [int(b.get("id")) for x in lists for b in x.findall("a")] if two else []))
    return sorted(frames, key=str), sorted(divisions, key=str)


def found(spark, path):
    frames, divisions = read_lineage_xml(spark, str(path))
    return sorted((tuple(r) for r in frames.collect()), key=str), sorted(((r.field, r.mother, r.daughters) for r in divisions.collect()), key=str)


def test_five_nested_cells(spark, tmp_path):
    s = lambda i: f'<ss><s i="{i}" x="1.5" y="2" s="4"/></ss>'
    text = f'<fs><f id="9"><as><a id="1">{s(0)}<as><a id="2">{s(1)}<as><a id="4">{s(2)}</a><a id="5">{s(2)}</a></as></a><a id="3">{s(1)}</a></as></a></as></f></fs>'
    (tmp_path / "l.xml").write_text(text)
    frames, divisions = found(spark, tmp_path / "l.xml")
    assert len(frames) == 5 and divisions == [(9, 1, [2, 3]), (9, 2, [4, 5])]
    assert (frames, divisions) == by_tree(tmp_path / "l.xml")


def test_any_tree_in_small_blocks(spark, tmp_path):
    """Random trees, chains as deep as 300 cells, empty elements, several lists and fields, files of many blocks."""
    rng = random.Random(7)
    ids = iter(range(10**6))

    def spots():
        return "".join(f"\n <s i='{rng.randrange(99)}' x=\"{rng.random():.3f}\" y=\"-3\" s='{rng.choice([4, 5, 7])}' />" for _ in range(rng.randrange(4)))

    def cell(depth):
        if rng.random() < 0.1:
            return f'<a id="{next(ids)}"/>'
        # a chain goes down by hand, as Python's own stack is short
        inner = ""
        for _ in range(rng.choice([0, 1, 1, 2])):
            n = rng.choice([0, 1, 2, 2, 2, 3]) if depth else 0
            inner += "<as/>" if not n and rng.random() < 0.5 else "<as>" + "".join(cell(depth - 1) for _ in range(n)) + "</as>"
        return f'<a brush="c{rng.randrange(3)}" id="{next(ids)}" type=\'t\'><ss>{spots()}</ss>{inner}</a>'

    def chain(n):
        return "".join(f'<a id="{next(ids)}"><ss>{spots()}</ss><as>' for _ in range(n)) + cell(2) + "</as></a>" * n

    for k in range(4):
        fields = "".join(f'<f id="{k * 10 + j}">\n<as>{cell(6)}{chain(rng.choice([3, 300]))}</as></f>' for j in range(3))
        (tmp_path / f"{k}.xml").write_text(f'<?xml version="1.0"?>\n<root><fs>{fields}</fs></root>\n')
    want = [by_tree(tmp_path / f"{k}.xml") for k in range(4)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 1024)
    try:
        frames, divisions = found(spark, tmp_path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum((tmp_path / f"{k}.xml").stat().st_size for k in range(4)) > 12 * 4096
    assert frames == sorted((r for f, _ in want for r in f), key=str) and len(frames) > 1000
    assert divisions == sorted((r for _, d in want for r in d), key=str) and sum(len(d) == 2 for *_, d in divisions) > 20
    assert found(spark, tmp_path) == (frames, divisions)
