"""Repeated lines of a few words, with the default floor; token counts of odd tables."""

from loamgrid.llm import op9_counts, op10_lines

from .helpers import documents


def test_short_repeated_lines_are_deleted(spark):
    rows = [(1, "All rights reserved by the owner\none\n\n--"), (2, "two\nAll rights reserved by the owner"), (3, "--\n\nthree\none")]
    got = {r["doc_id"]: (r["_n_removed"], r["text"]) for r in op10_lines.line_dedup(documents(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, "two"), 3: (0, rows[2][1])}


def test_runs_of_short_lines_are_deleted(spark):
    menu = "Home\nAbout us\n\nOur team\nContact"
    rows = [(1, f"a\n{menu}\nb"), (2, f"c\n{menu}\nd"), (3, "Home\nAbout us\ne"), (4, "About us\n\nOur team\nContact\nf")]
    got = {r["doc_id"]: (r["_n_removed"], r["text"]) for r in op10_lines.line_dedup(documents(spark, rows)).collect()}
    # three words of doc 3 stay, as no run of five is repeated there; in doc 4 one is
    assert got == {1: (0, rows[0][1]), 2: (5, "c\nd"), 3: (0, rows[2][1]), 4: (4, "f")}


def test_token_counts_of_odd_tables(spark):
    word = "extraordinarily" * 20_000
    docs = spark.createDataFrame([(1, word, 9), (1, word, 9), (None, None, 1), (2, "", 2)], "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_words"]) for r in op9_counts.token_counts(docs).collect()))
    machine, _ = op9_counts.automaton(op9_counts.VOCABULARY)
    assert got == [(0, 0, 0), (1, machine.length(word), 1), (1, machine.length(word), 1), (2, 0, 0)] and machine.length(word) > 20_000
    assert op9_counts.token_counts(docs.limit(0)).count() == 0
