"""Accepted changes, field by field, against a plain restatement."""

import itertools
import re

from pyspark.sql import functions as F

from corvane.operators import accept as A

NOW = "id long, name string, note string, height_cm string, shape_kind string, career string, sizes string, aliases array<string>"
GIVEN = "id long, fields map<string,string>, aliases array<string>, more_aliases array<string>"


def run(spark, now, given):
    return {r["id"]: r for r in A.accept(spark.createDataFrame(now, NOW), spark.createDataFrame(given, GIVEN)).collect()}


def plain_career(now, start, end):
    m = re.fullmatch(r"(\d*)(?:-(\d*))?", now or "")
    s = start or (m[1] if m else "")
    e = end or (m[2] or "" if m else "")
    if start is None and end is None or not (s or e):
        return now
    return f"{s}-{e}" if s else f"-{e}"


def plain_sizes(now, given):
    m = re.fullmatch(r"(\d*)([A-Z]*)-?(\d*)-?(\d*)", now or "")
    old = dict(zip(("band_size", "cup_size", "waist_size", "hip_size"), m.groups()))
    if not given:
        return now
    v = {k: given.get(k, old[k]) for k in old}
    return "-".join([v["band_size"] + v["cup_size"], v["waist_size"], v["hip_size"]]).rstrip("-") or None


def test_spans_and_sizes(spark):
    nows = [None, "", "2001", "2001-", "2001-2010"]
    spans = list(itertools.product(nows, [None, "1999"], [None, "2020"]))
    sizes = list(itertools.product([None, "34C-24-36", "34-24"], [{}, {"cup_size": "D"}, {"hip_size": "40"}, {"band_size": "30", "waist_size": "22"}]))
    now = [(k, "n", None, None, None, s[0], None, None) for k, s in enumerate(spans)] + [(100 + k, "n", None, None, None, None, s[0], None) for k, s in enumerate(sizes)]
    given = [(k, {n: v for n, v in zip(("start_year", "end_year"), s[1:]) if v}, None, None) for k, s in enumerate(spans)] + [(100 + k, s[1], None, None) for k, s in enumerate(sizes)]
    out = run(spark, now, given)
    assert [out[k].career for k in range(len(spans))] == [plain_career(*s) for s in spans]
    assert [out[100 + k].sizes for k in range(len(sizes))] == [plain_sizes(*s) for s in sizes]


def test_texts_numbers_and_what_is_absent(spark):
    now = [(k, f"N{k}", "old", "170", None, None, None, ["x"]) for k in range(4)]
    out = run(spark, now, [(0, {"note": None, "height": " 0180 "}, None, None), (1, {"height": "tall", "shape": "oval"}, None, None), (2, {}, None, None)])
    assert (out[0].note, out[0].height_cm, out[0].aliases) == (None, "180", ["x"])
    assert (out[1].note, out[1].height_cm, out[1].shape_kind) == ("old", "tall", "oval")
    assert (out[2].note, out[2].height_cm, out[2].aliases) == (out[3].note, out[3].height_cm, out[3].aliases) == ("old", "170", ["x"])


def test_aliases(spark):
    now = [(1, "Ann", None, None, None, None, None, ["A", "b"]), (2, "Bob", None, None, None, None, None, None), (3, "Cy", None, None, None, None, None, ["q", "q"])]
    out = run(spark, now, [(1, {}, ["zz"], ["B", "c", "C", "Bob", " "]), (2, {"name": "Bo"}, ["bo", "Bob", " x ", "X", None], None)])
    assert out[1].aliases == ["A", "b", "c"]  # those that are added count, not the given ones; another's name goes
    assert (out[2].name, out[2].aliases) == ("Bo", ["x"])  # the new name and all names there are
    assert out[3].aliases == ["q", "q"]


def test_batch_choices(spark):
    rows = [
        (1, "person", "name", "name", "Old", "New", None, None), (1, "person", "note", "simple", "n", "", None, None), (1, "person", "aliases", "list", None, None, ["a"], ["b", "a"]),
        (2, "scene", "name", "name", "Old", "New", None, None), (3, "tag", "note", "simple", "same", "same", None, None), (3, "tag", "aliases", "list", None, None, ["a"], ["a"]),
        (4, "tag", "note", "simple", None, "x", None, None),
    ]
    df = spark.createDataFrame(rows, "id long, type string, field string, kind string, local string, upstream string, local_list array<string>, upstream_list array<string>")
    out = {r["id"]: r for r in A.batch_choices(df).collect()}
    assert set(out) == {1, 4}
    assert (out[1].fields, out[1].aliases, out[1].more_aliases, out[1].accepted) == ({"name": "New"}, ["a", "b"], ["Old"], 2)
    assert (out[4].fields, out[4].aliases, out[4].more_aliases) == ({"note": "x"}, None, [])
    assert A.accept(spark.createDataFrame([(4, "T", None, None, None, None, None, None)], NOW), A.batch_choices(df)).where(F.col("note") == "x").count() == 1
