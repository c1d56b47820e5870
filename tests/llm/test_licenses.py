import re

from flowlake.llm import licenses

TEXTS = [
    "Licensed under CC BY-NC 4.0. All rights reserved", "cc by cc by", "General  public\nLICENSE", None, "", "all rights-reserved all rights", "éall rights reserved",
    "This work is licensed under the GNU General Public License, version 3", "Licensed under the Apache License, Version 2.0", "cc by",
    "x " * 30000 + "all rights reserved " * 2, "Released under the MIT License", "ccK by K cc by", "Permission is hereby granted, free of extra charge, to any person obtaining a copy of this software and the associated documentation files",
    "general public general public license license",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x"), (0, TEXTS[0], "x")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    want = sorted(str((i, *brute(t))) for i, t, _ in rows)
    assert sorted(str(tuple(r)[:6]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[8]["labels"] == "apache-2.0" and by[11]["labels"] == "mit" and by[13]["labels"] == "mit-text" and by[5]["labels"] == "reserved" and by[6]["labels"] == ""
    assert set(by[7]["labels"].split(",")) == {"gnu-gpl", "gpl"}
    assert by[4]["score"] == 0 and by[8]["score"] == 1


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_scan(df).collect() == []
    plan = licenses.license_scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
