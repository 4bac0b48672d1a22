"""Alignment of two vocabularies against a plain version, one document at a time."""

import hashlib
from collections import Counter

import pytest

from fundlattice.llm import align
from fundlattice.llm.bpe import byte_letters
from fundlattice.llm.common import stash_by, unstash

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", " ", "  two  spaces ", "line\n next\n\nx", "tab\t x \t", "naïve café — déjà", "日本語のテキスト 123４５", "x ▁ y", "<s> </s> <0x0A> <|endoftext|>",
       "\x00 a\x1fb", "😀 smile 😀😀", "I'll don't 'tis", "ﬁne é  nbsp 　wide", "a" * 3000, "word " * 500, "  a\u0085 b \x1c c"]


def brute(texts):
    """The rows as stated, with both libraries on whole texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def ends(tokens):
        n, out = 0, []
        for t in tokens:
            n += len(t)
            out.append(n)
        return out

    docs = []
    for text in texts:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a = b = a_bytes = b_bytes = []
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        at_a, at_b = dict(zip(a_ends, a)), dict(zip(b_ends, b))
        cuts = sorted(set(at_a) & set(at_b))
        groups = [",".join(str(i) for i, e in zip(a, a_ends) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, b_ends) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((len(a), len(b), [(at_a[c], at_b[c]) for c in cuts], ";".join(groups)))
    counts = Counter(p for d in docs for p in d[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "", g) for n_a, n_b, links, g in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("portion,few", [(align.PORTION, align.BROADCAST_IDS), (50, 0)])
def test_alignment_by_brute_force(spark, monkeypatch, portion, few):
    """Odd texts, repeated rows and null ids, beside clashing names; many small portions and pairs that aren't broadcast."""
    monkeypatch.setattr(align, "PORTION", portion)
    monkeypatch.setattr(align, "PART", min(portion, align.PART))
    monkeypatch.setattr(align, "BROADCAST_IDS", few)
    rows = [*enumerate(ODD), (3, "a b"), (3, "a b"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, unit string, n_a int").repartition(3)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in align.align(df).collect()), key=repr)
    assert got == sorted(((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows]))), key=repr)


def test_alignment_of_nothing(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in align.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", "")]


def test_tokens_are_not_exchanged(spark):
    """Rows of tokens are joined where their portion lies."""
    rows = spark.createDataFrame([(1, 0, [1 << 10 | 2, 2 << 10 | 1], [7 << 10 | 3])], "portion long, no int, a array<int>, b array<int>")
    types = stash_by(rows, "portion", 3, "types")
    with align._co_partitioned(spark):
        found = align.alignments(types, ["portion", "no"])
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.select("groups").first()[0] == "1,2|7"
    unstash(types)


def test_op11_by_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet")
    want = {i: r[:-1] for i, r in zip(t["doc_id"].to_pylist(), brute(t["text"].to_pylist()))}
    from fundlattice.llm.align import op11_alignment

    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS[:-1]) for r in op11_alignment(spark, SF).collect()} == want


def test_units_are_encoded_as_flat_arrays():
    """Plain units beside long and odd ones, in any order, with and without a space before them."""
    pair = align.vocabularies(align.A_FILE, align.B_FILE)
    units = [" " + "y" * 900, " a b", ",", " a", " \n", ".", " 日本", "!" * 500]
    for order in (units, units[::-1], units[1:2], units[:1]):
        for side, name in zip(pair.encode(order), "ab"):
            alone = [pair.encode([u])["ab".index(name)].to_pylist()[0] for u in order]
            assert side.to_pylist() == alone
    a, b = (x.to_pylist()[0] for x in pair.encode([" a b"]))
    assert [t >> align.SIZE_BITS for t in a] == pair.a.encode(" a b").ids and [t >> align.SIZE_BITS for t in b] == pair.b.encode("a b")
    assert sum(t & 1023 for t in a) == sum(t & 1023 for t in b) == 4


def test_groups_are_parts_of_a_text(spark):
    """No lists of tokens are cut for each group."""
    rows = spark.createDataFrame([(1, [1 << 10 | 2, 22 << 10 | 1, 3 << 10 | 1], [7 << 10 | 3, 8 << 10 | 1]), (2, [5 << 10 | 1], [6 << 10 | 1])], "no int, a array<int>, b array<int>")
    found = align.alignments(rows, ["no"])
    assert "slice(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["no"], r["groups"], [tuple(x) for x in r["links"]]) for r in found.collect()) == [(1, "1,22|7;3|8", [(22, 7), (3, 8)]), (2, "5|6", [(5, 6)])]


def test_only_inner_ends_are_looked_for(spark):
    """Rows with one token on a side are no rows of windows, and last tokens are never exploded ones."""
    token = lambda *sizes: [(k + 1) * 11 << 10 | n for k, n in enumerate(sizes)]
    lots = [(1, token(3), token(1, 1, 1)), (2, token(1, 2), token(3)), (3, token(1, 2), token(2, 1)), (4, token(1, 2, 1), token(1, 1, 2)), (5, token(2, 1, 1), token(2, 2)), (6, token(4), token(4))]
    found = align.alignments(spark.createDataFrame(lots, "no int, a array<int>, b array<int>"), ["no"])
    got = {r["no"]: (r["n_a"], r["n_b"], r["groups"], [tuple(x) for x in r["links"]]) for r in found.collect()}
    assert got == {
        1: (1, 3, "11|11,22,33", [(11, 33)]), 2: (2, 1, "11,22|11", [(22, 11)]), 3: (2, 2, "11,22|11,22", [(22, 22)]),
        4: (3, 3, "11|11;22,33|22,33", [(11, 11), (33, 33)]), 5: (3, 2, "11|11;22,33|22", [(11, 11), (33, 22)]), 6: (1, 1, "11|11", [(11, 11)]),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(pos#" in plan and "size(a#" in plan and plan.count("Window [") == 2
