"""Fill in the middle: against slices of Python strings, and exact round trips."""

import hashlib

import pytest
from text_cases import LONG, documents

from tablewright.llm import middle

ROWS = [(1, "héllo 𝒳𝒳 wörld"), (2, None), (3, ""), (4, "x<P>y"), (5, "a\nb\r\n$1\\2"), (None, "no id"), (6, "😀" * 9_000 + "end"),
        (7, LONG), (8, "x" * middle.BLOCK), (9, "é" * (middle.BLOCK + 1)), (9, "é" * (middle.BLOCK + 1))]
ROWS += [(n, "<S" * (n % 5) + "M>ab<" * n) for n in range(10, 90)]


def plain(doc_id, text):
    """n, form, prefix, middle and output by the rule."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    hashes = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted(h % (n + 1) for h in hashes[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or hashes[2] % 100 >= 90:
        return n, "plain", None, None, text
    if hashes[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_against_slices(spark):
    rows = middle.restore(middle.transform(spark.createDataFrame(ROWS, "doc_id bigint, text string"))).collect()
    assert len(rows) == len(ROWS) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")


def test_awkward_rows_clashing_names_and_no_rows(spark):
    docs = documents(spark, clashing=True).selectExpr("*", "'own' AS n", "'own' AS form", "'own' AS output", "'own' AS _whole")
    made = middle.restore(middle.transform(docs))
    assert made.columns == [*docs.columns, "n_", "form_", "prefix_chars", "middle_chars", "output_", "restored"]
    made = middle.transform(docs)
    assert all(r["n_"] == len(r["text"] or "") and r["n"] == r["form"] == "own" for r in made.collect())
    assert middle.digests(documents(spark, rows=[])).count() == 0


def test_other_marks_and_shares(spark):
    marks = middle.Marks("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(n, f"text {n} <P> [") for n in range(60)], "doc_id bigint, text string")
    rows = middle.restore(middle.transform(docs, percent=100, spm_percent=50, marks=marks), marks=marks).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"} and all(r["restored"] == r["text"] for r in rows)
    assert all(r["output"].startswith("[pre]" if r["form"] == "psm" else "[suf]") for r in rows)
    for wrong in (("<a>", "<b>", "<a>"), ("<a>", "<a>b", "<c>"), ("<a<", "<b>", "<c>"), ("$1", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            middle.Marks(*wrong)


def test_what_is_no_output_is_not_restored(spark):
    rows = spark.createDataFrame([("<P>a<S>b", "psm"), ("<P>a<S>c<M>b", "psm"), ("abc", "spm"), ("abc", "plain")], "output string, form string")
    assert [r["restored"] for r in middle.restore(rows).collect()] == [None, "abc", None, "abc"]


def test_no_python_and_no_shuffle_in_the_plan(spark):
    plan = middle.digests(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1] and "Exchange" not in plan and "InArrow" not in plan
