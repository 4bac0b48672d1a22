"""Repeated strings against a plain version that holds every string's smallest id."""

import hashlib
import random

import numpy as np
import pytest

from fundlattice.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def brute(rows, length):
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    least = {}
    for i, t in zip(ids, texts):
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in zip(ids, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


def case(seed=1):
    r = random.Random(seed)
    words = [("".join(r.choices("abcdeé", k=r.randint(1, 7)))) for _ in range(60)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    base, line = prose(120), prose(14)
    rows = [(k, prose(r.randint(0, 90))) for k in range(20)]
    rows += [(100 + k, base) for k in range(4)] + [(90, base[:300] + "X" + base[301:]), (95, base[17:200])]  # copies, a near copy, a part
    rows += [(200 + k, prose(r.randint(0, 30)) + line + prose(r.randint(0, 30))) for k in range(30)]  # a common passage
    rows += [(300, "a" * 400), (301, "b" + "a" * 180 + "c"), (302, "a" * 49), (303, "ab" * 100), (304, "ab" * 90), (305, ""), (306, None), (None, base), (None, line * 3), (7, base), (7, base), (308, line + line)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [50, 8, 90])
@pytest.mark.parametrize("portion,piece,split", [(sd.PORTION, sd.PIECE, sd.SPLIT), (700, 200, 3), (3000, 64, 0)])
def test_repeats_by_brute_force(spark, monkeypatch, length, portion, piece, split):
    """Texts in many portions and pieces; keys that are dealt out by their strings; odd rows beside clashing names."""
    for name, value in (("PORTION", portion), ("PIECE", max(piece, length)), ("SPLIT", split), ("SLICE", 64 if split == 3 else sd.SLICE), ("SORTED", 300 if split == 3 else sd.SORTED)):
        monkeypatch.setattr(sd, name, value)
    rows = case()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, packed string, n_bytes int").repartition(3)
    got = sorted(((r["doc_id"], *(bytes(v) if isinstance(v, bytearray) else v for v in (r[c] for c in COLUMNS))) for r in sd.remove_repeats(df, length=length).collect()), key=repr)
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, brute(rows, length))), key=repr)


def test_repeats_of_nothing(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_sort_as_their_bytes():
    r = np.random.default_rng(3)
    flat = r.integers(97, 99, 3000).astype(np.uint8)
    starts = r.integers(0, 2900, 500)
    group = np.sort(r.integers(0, 20, 500))
    s = sd.Suffixes(flat, starts, 40)
    text = [flat[a : a + 40].tobytes() for a in starts]
    assert s.sort(group).tolist() == sorted(range(500), key=lambda k: (group[k], text[k], k))
    found = s.classes(group)
    assert all((found[a] == found[b]) == ((group[a], text[a]) == (group[b], text[b])) for a in range(0, 500, 7) for b in range(500))


def test_colliding_hashes_are_seen(monkeypatch):
    """With hashes that are all equal, bytes decide."""
    monkeypatch.setattr(sd.PrefixHashes, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
    flat = np.frombuffer(b"abcdefgh" * 20 + b"abcdexgh" * 20, np.uint8)
    starts = np.array([0, 8, 160, 168])
    found = sd.Suffixes(flat, starts, 16).classes(np.zeros(4, np.int64))
    assert found[0] == found[1] != found[2] == found[3]


def test_every_string_has_an_anchor_at_its_own_place():
    r = np.random.default_rng(5)
    flat = r.integers(97, 101, 5000).astype(np.uint8)
    place, _ = sd.anchors(flat, np.array([1200, 30, 3770]), 50)
    m = sd.seed_length(50)
    for start in [*range(0, 1151), *range(1230, 4951)]:
        assert ((place >= start) & (place <= start + 50 - m)).any()


def test_op13_by_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    want = {i: b[:-1] for (i, _), b in zip(rows, brute(rows, 50))}
    assert sum(w[1] > 0 for w in want.values()) > 3
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS[:-1]) for r in sd.op13_suffix_dedup(spark, SF).collect()} == want
