import re

from pyspark.sql import functions as F

from cohortscope.llm.licenses import NOTICES, ORACLE, SHINGLE, notices, op6_licenses, scan_licenses
from workload.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, license_id string, words int"


def brute(texts, templates):
    """Licenses by sliding every window of every width that any template has."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    cut = lambda w: {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
    found = {}
    for doc, text in texts:
        words = split(text)
        for name, template in templates:
            n, width = len(split(template)), 8
            while width * 3 // 4 + 1 < n:
                width *= 2
            parts = cut(split(template))
            for start in range(0, len(words), width // 4):
                share = len(cut(words[start : start + width]) & parts) / len(parts) if parts else 0
                if share >= 0.8:
                    found[doc, name] = max(found.get((doc, name), 0), share)
    return found


def test_against_brute_force_with_odd_rows(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    texts = [
        (i, f"{filler[: 7 * i]} {text.upper()} {filler}") for i, (_, text) in enumerate(NOTICES)
    ] + [(100, None), (101, ""), (102, "license"), (103, "Released under the MIT"), (None, NOTICES[0][1])]
    long = " ".join(f"clause{i} of this license" for i in range(40))
    texts += [(200, f"{filler} {long} {filler}"), (201, long.replace("clause7 ", "")), (202, "the apache license version " * 50)]
    templates = [*NOTICES, ("Long", long), ("Short", "MIT License"), ("Null", None)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts] * 2, SCHEMA)
    got = scan_licenses(docs, spark.createDataFrame(templates, "license_id string, text string"))
    assert {(r.doc_id, r.license_id): r.containment for r in got.collect()} == brute(texts, [t for t in templates if t[1]])


def test_grants_and_headers_in_a_very_long_text(spark):
    grant = max((t for i, t in NOTICES if i == "MIT"), key=len)
    header = max((t for i, t in NOTICES if i == "LGPL-3.0"), key=len)
    filler = " ".join(f"w{i % 1009}" for i in range(40_000))
    cut = " ".join(grant.split()[:40])
    texts = [(1, f"{filler} {grant} {filler} {header}"), (2, f"{filler} {cut}"), (3, filler)]
    got = scan_licenses(spark.createDataFrame([(d, t, "x", 1) for d, t in texts], SCHEMA), notices(spark)).collect()
    found = {(r.doc_id, r.license_id): r.containment for r in got}
    # The first words of the grant are a template of their own.
    assert found == {(1, "MIT"): 1.0, (1, "LGPL-3.0"): 1.0, (2, "MIT"): 1.0}


def test_no_license_is_taken_for_another(spark):
    texts = [text for _, text in NOTICES]
    header = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General " \
        "Public License as published by the Free Software Foundation, either version {} of the License, or (at your " \
        "option) any later version."  # fmt: skip
    texts += [header.format("program", "", 3), header.format("library", "Lesser ", 3), header.format("program", "", 2),
              header.format("library", "Lesser ", 2), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
              "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Mozilla Public License Version 1.1"]
    want = [{i} for i, _ in NOTICES] + [{"GPL-3.0"}, {"LGPL-3.0"}, set(), set(), {"GPL-3.0"}, {"LGPL-3.0"}, set()]
    docs = spark.createDataFrame([(i, f"some words {t} more words", "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = [set() for _ in texts]
    for r in scan_licenses(docs, notices(spark)).collect():
        got[r.doc_id].add(r.license_id)
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, NOTICES[0][1], "x", 1)], SCHEMA)
    assert scan_licenses(docs.limit(0), notices(spark)).count() == 0
    assert scan_licenses(docs, notices(spark).limit(0)).count() == 0


def test_whole_table_against_sql(spark):
    got = op6_licenses(spark, SF_DIR)
    assert compare(got, connect(SF_DIR), ORACLE) == ""
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert got.filter(F.col("containment") == 1).count() > 0
