"""Full license texts in several wrappings."""

import textwrap

import pytest

from sessionloom.llm import licenses

PARAGRAPHS = {name: [" ".join(p.split()) for p in text.split("\n\n")] for name, text in (("MIT", licenses._MIT), ("ISC", licenses._ISC))}


def wrapped(name, width):
    return "\n\n".join(textwrap.fill(p, width) if width else p for p in PARAGRAPHS[name])


@pytest.mark.parametrize("line", ["", "Copyright (c) 2020 Some One\n\n", "Copyright Some Company Inc.\n\n", "© 2021 Some One\n\n"])
def test_full_texts_in_any_wrapping(spark, line):
    cases = [(name, width) for name in PARAGRAPHS for width in (0, *range(60, 121))]
    docs = spark.createDataFrame([(k, line + wrapped(*c)) for k, c in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(docs).collect()}
    assert {cases[k]: v for k, v in found.items()} == {c: (c[0], [c[0]]) for c in cases}
