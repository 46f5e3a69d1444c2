"""Whole notices, wrapped at several widths, get their family and no other; ordinary lines with cue words none."""

import textwrap

from quillstrata.llm import licenses

DATA = "/root/testdata/sf0.001"


def test_wrapped_notices(spark):
    rows = [(f, "\n".join(["A file about birds.", "", *textwrap.wrap(notice, width), "", "Then the text goes on."])) for width in (60, 72, 79) for f, notice in licenses.NOTICES.items()]
    plain = "He asked for permission to leave the house before dawn on Sunday.\nThe warranty of the car ran out in March of last year.\nCopyright questions were discussed at length during the meeting."
    rows += [("", plain), ("apache-2.0,mit", "Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.")]
    said = spark.createDataFrame([(-1 - i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in licenses.license_verdicts(docs.union(said)).where("doc_id < 0").collect()}
    for i, (family, text) in enumerate(rows):
        r = got[-1 - i]
        assert r.families == family, (family, r)
        lines = sum(bool(x) for x in text.split("\n"))
        assert r.n_paragraphs == lines and (not family or r.n_confirmed >= 0.9 * r.n_cued), r
    wrapped = [got[-1 - i] for i, (family, _) in enumerate(rows) if family and "," not in family]
    assert sum(r.n_confirmed for r in wrapped) >= 0.95 * sum(r.n_paragraphs - 2 for r in wrapped)
