"""Fill-in-middle against a plain version."""

import hashlib
import re

import pytest

from fundlattice.llm import fim
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "  ", "ab cd", "héllo wörld", "日本語 abc", "x<P>y", "<S>", "tail<", "S>ab", "a" * 700, "é" * 300, "ab, " * 200, "a\nb\r\n\x00c", "😀a😀bc"]


def plain(name, text, seed=1):
    """(n, form, prefix, middle, output) as stated, token by token."""
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size,long", [(fim.CHUNK, fim.LONG), (5, 10**9), (5, 3), (1, 0)])
def test_fill_in_middle_by_brute_force(spark, size, long):
    """Any chunk size, counted in place or dealt out, on odd texts, repeated rows and null ids, beside clashing names."""
    rows = [(i, t) for k in range(4) for i, t in enumerate(ODD, 100 * k)] + [(3, "again and again")] * 2 + [(None, "no id at all")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    found = fim.fill_in_middle(df, size=size, long=long)
    back = found.select("*", fim.restore(found["output"], found["form"]).alias("back")).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in back), key=repr)
    want = sorted(((i, *plain("null" if i is None else i, t or ""), t or "") for i, t in rows), key=repr)
    assert got == want


def test_fill_in_middle_of_nothing(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_of_a_long_text_are_found_in_their_chunks(spark):
    text = "word, and word; " * 60_000
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fim.fill_in_middle(df, long=500_000).collect()}
    for i in range(6):
        assert tuple(got[i][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == plain(i, text)


def test_op12_matches_sql(spark):
    assert_same(fim.op12_fill_in_middle(spark, SF), connect(SF), fim.OP12_SQL)
