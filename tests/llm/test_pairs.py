"""Searches and joins on pairs against brute force, and the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fundlattice.llm import graph, neighbours, registry, shingle_join, vector_dedup
from fundlattice.llm.langid import SIGNIFICANT, bars, held_out, identify, learn
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 400)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs + pairs[:9], "a long, b long")).collect()}
    want = closure(pairs, {x for p in pairs for x in p})
    assert all(got.get(n, n) == c for n, c in want.items()) and set(got) <= set(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors


def vectors(seed=0, n=240, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = [(i, (base[i % len(base)] + 0.06 * rng.normal(size=dim) * (i % 3)).astype(np.float32).tolist(), int(i % 2)) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [None] + [1.0] * (dim - 1), 1), (2003, [float("nan")] * dim, 1), (2004, [float("inf")] * dim, 1), (2005, rows[5][1], None), (2006, [float(np.float32(3.0)) * x for x in rows[5][1]], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score int, v string")


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_neighbours_by_brute_force(spark, block):
    rows = vectors()
    out = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=9, block=block).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if fine(v)]
    for i, v in good:
        if i % 20 == 0:
            scores = sorted((-float((v * w).sum()), j) for j, w in good if j != i)[:9]
            assert [j for _, j in scores] == [j for j, _ in got[i]]
            assert np.allclose([-s for s, _ in scores], [s for _, s in got[i]], rtol=1e-12)
    assert set(got) == {i for i, _ in good if i % 20 == 0}


def test_vectors_of_unequal_sizes_do_not_meet(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(4, 7, 9)[i % 3]).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], 1) for i in range(6)]
    out = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=30, block=16).collect()
    size = {i: len(v) for i, v, _ in rows}
    assert all(size[r["query_id"]] == size[r["vec_id"]] for r in out)
    assert len(out) == sum(sum(size[i] == size[j] for j in size if j != i) for i in size if i % 20 == 0)
    for pivots in (1, 5):
        got = {r["vec_id"]: r for r in vector_dedup.link(frame(spark, rows), pivots=pivots, block=8).collect()}
        assert all(got[100 + i]["component_id"] == i and got[i]["n_links"] == 1 for i in range(6)) and len(got) == 66


def test_links_at_exactly_the_bound(spark):
    """(24, 7) and (1, 0): cosine 24 / 25 = 0.96, which rounding must not lose; a hair less does not link."""
    rows = [(1, [24.0, 7.0], 1), (2, [1.0, 0.0], 1), (3, [23.999, 7.0], 2), (4, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in vector_dedup.link(df, least=0.96).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_neighbours_of_few(spark):
    rows = frame(spark, vectors()[:3])
    assert neighbours.nearest(rows, F.col("vec_id") == 0).count() == 2
    assert neighbours.nearest(rows, F.lit(False)).count() == 0 and neighbours.nearest(rows.limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(20, 64)), rng.normal(size=(300, 64)) * rng.lognormal(size=(300, 1))
    cq, sq, eq, nq = neighbours.quantise(q)
    cc, sc, ec, nc = neighbours.quantise(c)
    about = (cq.astype(float) @ cc.T.astype(float)) * sq[:, None] * sc
    slack = eq[:, None] * nc + np.linalg.norm(cq * sq[:, None], axis=1)[:, None] * ec
    assert (np.abs(about - q @ c.T) <= slack * (1 + 1e-9)).all()


@pytest.mark.parametrize("pivots, block", [(1, 2048), (9, 2048), (9, 11), (40, 64)])
def test_vector_links_by_brute_force(spark, pivots, block):
    rows = vectors()
    out = {r["vec_id"]: r for r in vector_dedup.link(frame(spark, rows), pivots=pivots, block=block).collect()}
    good = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if fine(v) and g is not None}
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    want = closure(pairs, [r[0] for r in rows])
    for i, *_ in rows:
        assert out[i]["n_links"] == sum(i in p for p in pairs), i
        assert out[i]["component_id"] == want[i] and out[i]["kept"] == (want[i] == i)
    assert len(out) == len(rows) and len(pairs) > 300


def test_vector_links_without_rows(spark):
    assert vector_dedup.link(frame(spark, vectors()).limit(0)).count() == 0
    r = vector_dedup.link(frame(spark, [(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)])).collect()
    assert {(x["vec_id"], x["component_id"], x["n_links"]) for x in r} == {(None, None, 0), (4, 4, 0)}


# shingles


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_copies(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    out = [None, "", " \t\n", "One", "one", "one two", "ONE  two", "é É", "x " * 4000, "a\x1cb c", "a b c\u00a0d"]
    for _ in range(n // 6):
        words = rng.choices(vocabulary, k=rng.choice((5, 12, 25, 60, 200, 600)))
        if rng.random() < 0.5:
            words[3:3] = passage
        out.append(" ".join(words))
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 1, 2, 4, 9))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_shingle_groups_by_brute_force(spark, monkeypatch, k, percent, seed):
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    texts = near_copies(seed)
    df = spark.createDataFrame([(i, t, 5, "h", i) for i, t in enumerate(texts)], "doc_id long, text string, n int, h1 string, bits long")
    out = {r["doc_id"]: r for r in shingle_join.join_groups(df, k, percent).collect()}
    sets = [shingles(t, k) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = closure(pairs, range(len(texts)))
    for i in range(len(texts)):
        assert out[i]["n_shingles"] == len(sets[i]) and out[i]["component_id"] == want[i], (i, texts[i])
    assert len(out) == len(texts) and len(pairs) > 20


def random_set(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def keys_of(sets, percent):
    """Tile keys of each set, with the members' numbers counted plainly."""
    owner, value = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    found, at, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    who, keys = shingle_join.tile_keys(owner[shared], value[shared], times[at][shared], np.array([len(s) for s in sets]), percent)
    return [set(keys[who == i].tolist()) for i in range(len(sets))]


def tile_pairs(keys):
    tiles = {}
    for i, own in enumerate(keys):
        for key in own:
            tiles.setdefault(key, []).append(i)
    return sum(len(t) - 1 for t in tiles.values()), max((len(t) for t in tiles.values()), default=0)


def test_linked_sets_always_share_a_tile():
    rng = np.random.default_rng(7)
    tried = 0
    for percent in (50, 80, 90, 95):
        sets, linked = [], []
        for n in (1, 2, 5, 9, 10, 15, 19, 20, 37, 110, 400):
            for _ in range(12):
                pool = random_set(rng, 3 * n + 4)
                drop = rng.integers(0, max(1, n * (100 - percent) // 100 + 1))
                a, b = pool[:n], np.r_[pool[drop:n], pool[n : n + rng.integers(0, drop + 2)]]
                both = n - drop
                if len(b) and 100 * both >= percent * (n + len(b) - both):
                    linked.append((len(sets), len(sets) + 1))
                    sets += [a, b]
        keys = keys_of(sets, percent)
        assert all(keys[a] & keys[b] for a, b in linked)
        assert not any(keys[a] & keys[b] for (a, _), (_, b) in itertools.permutations(linked, 2))
        tried += len(linked)
    assert tried > 200


def test_tiles_grow_with_the_sets_that_link_only():
    """Unrelated sets never meet, with a common passage in a fifth of each neither; near copies grow in proportion."""
    rng = np.random.default_rng(8)
    passage = random_set(rng, 20)
    for count in (500, 2_000):
        sizes = rng.choice([8, 12, 30, 60, 100], count)
        assert tile_pairs(keys_of([random_set(rng, n) for n in sizes], 80)) == (0, 0)
        mixed = [np.r_[random_set(rng, n - n // 5), passage[: n // 5]] for n in sizes]
        assert tile_pairs(keys_of(mixed, 80)) == (0, 0)
    grown = []
    for groups in (50, 200):
        sets = []
        for _ in range(groups):
            base = random_set(rng, 60)
            sets += [np.r_[base[3 * i :], random_set(rng, 3 * i)] for i in range(3)]
        pairs, largest = tile_pairs(keys_of(sets, 80))
        assert largest <= 3
        grown.append(pairs)
    assert 3.5 * grown[0] < grown[1] < 4.5 * grown[0]


def test_frequent_members_are_counted_like_others(spark, monkeypatch):
    """Keys are the same whether members are sent one by one or counted, in one portion or several."""
    texts = [(i, f"a b c d e f g h w{i % 7} x{i % 3} y{i}") for i in range(60)]
    rows = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    found = []
    for apart, held in ((8, 1_500_000), (1, 1_500_000), (1_000, 1_500_000), (2, 40)):
        monkeypatch.setattr(shingle_join, "SENT_APART", apart)
        monkeypatch.setattr(shingle_join, "HELD_MEMBERS", held)
        monkeypatch.setattr(shingle_join, "PORTION", 100 if held < 100 else 300_000)
        found.append({tuple(r) for r in shingle_join.shared_keys(rows, 3, 50, 3, 48).collect()})
    assert found[0] and all(f == found[0] for f in found)


def test_closest_pairs_of_each_component():
    one, two, far = np.array([1, 1, 1, 2, 3]), np.array([5, 6, 7, 7, 7]), np.array([0.3, 0.1, 0.2, 0.4, 0.5])
    assert shingle_join.closest(one, two, far, 1).tolist() == [True] * 5  # each is the closest of some component
    far[0] = 0.05
    one[:], two[:] = 1, [5, 6, 5, 6, 6]
    assert shingle_join.closest(one, two, far, 1).tolist() == [True, True, False, False, False]
    assert shingle_join.closest(one, two, far, 8).all() and not len(shingle_join.closest(one[:0], two[:0], far[:0], 1))


def test_group_whose_members_are_just_below_the_bound(spark):
    """200 copies of a text, each with other changes: most pairs are near the bound, few of them link; brute force agrees."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(0, 120, 6), rng.choice((1, 2, 2, 3, 3))):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in shingle_join.join_groups(df, 5, 80).collect()}
    sets = [shingles(t, 5) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(200), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert out == closure(pairs, range(200)) and 100 < len(pairs) < 15_000


def test_bitmaps_bound_the_intersection():
    rng = np.random.default_rng(3)
    a, b = random_set(rng, 300), random_set(rng, 300)
    b[:200] = a[:200]
    owner = np.repeat([0, 1], 300)
    maps = shingle_join.bitmaps(owner, np.r_[np.sort(a), np.sort(b)], 2)
    differing = int(np.bitwise_count(maps[0] ^ maps[1]).sum())
    assert differing <= 200 and (600 - differing) // 2 >= 200


def test_shingle_groups_of_none_and_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "A b c d")], "doc_id long, text string")
    assert shingle_join.join_groups(df.limit(0)).count() == 0
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in shingle_join.join_groups(df).collect())
    assert got == [(-1, -1), (3, 3), (3, 3), (4, 3)]


# queries and pipeline


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert_same(df, connect(SF), registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def survivors(rows):
    """Positions of the rows that stay, by brute force: of each group the smallest id, and of its rows the first."""
    sets = {k: shingles(r["text"], 5) for k, r in enumerate(rows) if r["doc_id"] is not None}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = {}
    for k, root in closure(pairs, sorted(sets)).items():
        groups.setdefault(root, []).append(k)
    return sorted([min((rows[k]["doc_id"], k) for k in g)[1] for g in groups.values()] + [k for k, r in enumerate(rows) if r["doc_id"] is None])


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 456", "de", "s", 7), (None, "the and with that this", None, "s", 1), (903, "password=hunter2x the and with", None, "s", 1), (904, "Все люди рождаются свободными и равными в своем достоинстве и правах", None, "s", 1), (905, "日本語", None, "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    labelled = docs.where(~held_out())
    prototypes = learn(labelled)
    least = bars(labelled, prototypes)
    scores = {r["doc_id"]: r for r in identify(docs, prototypes).collect()}
    rows = kept.collect()
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in rows} == {i for i, r in scores.items() if r["lang_pred"] != "und" and r["score"] + SIGNIFICANT >= least[r["lang_pred"]] * r["effective"] ** 0.5}
    assert {r["doc_id"] for r in rows} & {900, 901, 902, 903, 904, 905} == {903, 905}
    assert all((r["lang"] is None) == (r["doc_id"] == 905) for r in rows)  # too short to tell

    one = corpus_pipeline.drop_near_duplicates(spark, kept, SF).collect()
    assert sorted(r["doc_id"] or 0 for r in one) == sorted(rows[k]["doc_id"] or 0 for k in survivors(rows))
    twice = corpus_pipeline.drop_near_duplicates(spark, kept.unionAll(kept), SF)
    assert twice.where("doc_id is not null").count() == len(one) - 1

    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact(spark, kept, SF).collect()}
    assert len(clean) == len(rows) and "[REDACTED]" in clean[903]
    packed = corpus_pipeline.pack_sequences(spark, kept.where("doc_id < 20"), SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 20}


def test_repeated_ids_do_not_change_other_groups(spark):
    near = [" ".join(f"w{i}" for i in range(40)) + end for end in ("", " x", " y z")]
    far = " ".join(f"u{i}" for i in range(30))
    rows = [(9, near[0]), (3, near[1]), (50, far), (7, near[2]), (None, far), (60, ""), (61, "")]
    for extra in ([], [(50, far)], [(50, "one more text of other words")], [(3, near[2]), (3, "again quite other words than that")], [(60, ""), (9, far)]):
        made = [{"doc_id": i, "text": t} for i, t in rows + extra]
        df = spark.createDataFrame([(r["doc_id"], r["text"], k, "a", "b") for k, r in enumerate(made)], "doc_id long, text string, _row int, row string, __row string").coalesce(1)
        got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
        want = survivors(made)
        ids = lambda ks: sorted((made[k]["doc_id"] or 0, made[k]["text"] if made[k]["doc_id"] != 3 else "") for k in ks)
        assert got.columns == df.columns and ids([r["_row"] for r in got.collect()]) == ids(want)


def test_columns_with_clashing_names_come_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["__lang", "__score", "__blob", "__spans", "__row", "__text", "_lang", "_score", "_effective", "_blob", "_spans", "_row", "bucket", "h1", "n", "row"]
    wide = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for twice in (False, True):
        now = wide.unionAll(wide) if twice else wide
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == wide.columns
        found = now.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in names)
        assert corpus_pipeline.pack_sequences(spark, now, SF).count() >= len(found)


def test_long_foreign_texts_and_random_letters_are_rejected(spark):
    rng = random.Random(1)
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era e cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura. Tanto e amara che poco e piu morte; ma per trattar del ben che vi trovai, diro delle altre cose.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista erotusta, kuten rotuun ja väriin.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na jakiekolwiek różnice rasy i koloru skóry.",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10_000)),
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3_000)),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(900 + i, t, None, "s", len(t)) for i, t in enumerate(foreign + [foreign[1][:90], foreign[2][:90]])], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(planted), SF)
    assert kept.where("doc_id >= 900").count() == 0 and kept.where("doc_id < 900").count() == docs.count()


@pytest.mark.parametrize("zipf", [1.0, 0.8])
def test_texts_of_a_learned_language_stay_at_all_lengths(spark, zipf):
    """A language of 20,000 random words, whose trigrams are nearly even: under 1 % of new texts go, and other languages' texts do."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(20_000)]
    share = 1 / np.arange(1, 20_001) ** zipf
    text = lambda n: " ".join(words[i] for i in rng.choice(20_000, n, p=share / share.sum()))
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    taught = [text(int(n)) for n in np.exp(rng.uniform(np.log(8), np.log(500), 500))]
    fresh = {n: [text(n) for _ in range(100)] for n in (8, 20, 40, 120, 500, 4_000)}
    rows = [(4 * k, t, "xx", "s", 1) for k, t in enumerate(taught)] + [(100_000 * (j + 1) + k, t, None, "s", 1) for j, ts in enumerate(fresh.values()) for k, t in enumerate(ts)]
    cyrillic = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, spark.createDataFrame([*rows, (-1, cyrillic, None, "s", 1)], schema), SF).collect()}
    for j in range(len(fresh)):
        assert len(kept & set(range(100_000 * (j + 1), 100_000 * (j + 1) + 100))) >= 99
    assert -1 not in kept


def test_pipeline_on_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_once_and_in_small_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify(docs, learn(docs), keep=tuple(docs.columns))
    assert found._jdf.queryExecution().analyzed().children().head().output().size() == len(docs.columns)
    assert "MapInArrow" not in corpus_pipeline.identify_language(spark, docs, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("same", [True, False])
def test_open_pairs_are_the_same_however_few_are_held(same):
    rng = np.random.default_rng(1)
    maps = np.repeat(rng.integers(0, 2**63, (1, 32)).astype(np.uint64), 60, axis=0)
    maps[np.arange(60), rng.integers(0, 32, 60)] ^= rng.integers(0, 2**20, 60).astype(np.uint64)
    one = (np.arange(60), rng.integers(0, 20, 60), rng.integers(200, 204, 60), maps)
    two = one if same else (np.arange(100, 160), rng.integers(0, 20, 60), one[2], maps)
    for most in (1, 8, 10_000):
        a, b, cut = shingle_join.open_pairs(one, two, same, 80, most, 1_000_000)
        assert len(a) and (most < 60) == (cut > 0)
        for held in (0, 50):
            x, y, less = shingle_join.open_pairs(one, two, same, 80, most, held)
            assert less == cut and x.tolist() == a.tolist() and y.tolist() == b.tolist()
