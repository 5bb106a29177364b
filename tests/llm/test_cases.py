"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute force where SQL has no say."""

import hashlib
import re

import pytest

pytest.importorskip("etherloom.llm")
from etherloom.llm import bpe, decontaminate, langid, licenses, lines, quality, secrets, simhash, substrings, toxicity  # noqa: E402
from etherloom.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, page string, label string, seed int, keys string"
PROSE = " ".join(f"wort{i % 97}x{i % 13}" for i in range(400))
KEY = "AKIA" + "Z9" * 10


def rows():
    base = [
        (1, PROSE, "de", "a"), (2, PROSE, "de", "b"), (2, PROSE, "de", "b"), (3, None, "en", "a"), (4, "", None, None),
        (5, "one", "en", "a"), (None, "no id here\nall rights reserved", "en", "a"), (6, "x" * 200_000, "en", "a"),
        (7, f"key {KEY} password = hunter22 token: ab\n" + "deadbeef" * 4, "en", "a"), (8, "same line\n\nsame line\n12 &&", "en", "c"),
        (9, "the software is licensed under the GNU General Public License version", "en", "c"), (10, "　\x1c\x85 é É", "fr", "c"),
    ]
    return [(d, t, g, s, len(t or ""), "h", "p", "l", 1, "k") for d, t, g, s in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    bench = spark.createDataFrame([(1, " ".join(PROSE.split()[40:70]), "x"), (2, None, "x"), (3, "", "x")], "item_id bigint, text string, doc_id string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (99, None, 0)], "doc_id bigint, quality int, toxic int")
    return {
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "quality": quality.line_rules,
        "bpe": lambda d: bpe.digest_documents(d, vocabulary()),
        "secrets": secrets.secret_spans,
        "substrings": substrings.remove_repeats,
        "simhash": simhash.simhash_components,
        "language": lambda d: langid.identify(d, langid.fit_documents(d)),
        "licenses": licenses.license_labels,
        "lines": lines.drop_frequent_lines,
        "digest": lines.line_digest,
    }, bench


@pytest.mark.parametrize("name", ["toxicity", "quality", "bpe", "secrets", "substrings", "simhash", "language", "licenses", "lines", "digest"])
def test_a_row_for_each_row(spark, docs, none, name):
    work = operators(spark)[0][name]
    assert work(docs).count() == docs.count()
    assert work(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = operators(spark)[1]
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_overlap"]) for r in found} == {(1, 1, 30), (2, 1, 30)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    words = PROSE.split()[40:70]
    words[7], words[19] = "other", "words"  # substitutions
    near = spark.createDataFrame([(20, "start " + " ".join(words) + " end")], "doc_id bigint, text string")
    assert [r["n_overlap"] - r["n_matched"] for r in decontaminate.contaminated(near, bench).collect()] == [2]


def test_pipeline_stages_keep_columns(spark, docs, none):
    model = langid.fit_documents(docs)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (3, 4)").count() == 0
    unique = simhash.drop_near_duplicates(docs)
    assert unique.columns == docs.columns and unique.where("doc_id IN (1, 2)").count() == 1
    assert simhash.drop_near_duplicates(none).count() == 0


def test_secret_spans(docs):
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs).collect()}[7]
    text = next(r[1] for r in rows() if r[0] == 7)
    a = text.index("password")
    wanted = [f"access:4:{4 + len(KEY)}", f"assign:{a}:{a + len('password = hunter22')}", f"hex:{text.index('deadbeef')}:{len(text)}"]
    assert got["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest()
    assert (got["n_assign"], got["n_access"], got["n_hex"]) == (1, 1, 1)


def test_copied_secret_is_an_example(spark):
    token = "Ab3dE5gH7jK9mN1pQ3sT5v"
    d = spark.createDataFrame([(i, f"x {token} y", f"owner{i}") for i in range(3)] + [(9, f"x {token[::-1]} y", "one")], "doc_id bigint, text string, source string")
    found = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in secrets.secret_spans(d).collect()}
    assert found == {0: (0, 1), 1: (0, 1), 2: (0, 1), 9: (1, 0)}


def test_substrings_against_brute_force(spark):
    texts = [(i, " ".join(f"w{(i // 3) * 5 + j % (17 + i)}" for j in range(60 + i)) if i else None) for i in range(12)]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    for i, w in words.items():
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k) for j in range(k, k + 20)}
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)


def test_bk_trees_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (30, 2))]))
    forest = simhash.Forest(np.zeros(len(prints), np.int64), prints)
    found = {(int(a), int(b)) for q, n in forest.within(np.zeros(len(prints), np.int64), prints, 2) for a, b in zip(q, n)}
    d = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert found == {(int(a), int(b)) for a, b in np.argwhere(d <= 2)}


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t, c = tokenizers.Tokenizer.from_file(vocabulary()), bpe.Codec(vocabulary())
    for x in ["", " \x1c ", "Don't <|endoftext|>STOP 12x", "İΣΑΣ ﬁ é 漢字🙂", "a" * 3000, PROSE]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x) == ids
        assert c.digest(x) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))


def test_viterbi_shortcut_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        s = -rng.uniform(0, 5, (6, 3)) * (rng.random((6, 3)) < 0.7)
        value = lambda p: sum(s[i, j] for i, j in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert value(tuple(langid.viterbi(s, 4.0))) == pytest.approx(best)


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(d, langid.fit_documents(d)).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_near_duplicates_of_five_words(spark):
    import random

    draw = random.Random(3)
    fresh = lambda n: [f"v{draw.randrange(5000)}" for _ in range(n)]
    texts, near, far = [], [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for k in range(200):
        w = fresh(draw.choice([40, 120, 400]))
        v = list(w)
        for at in draw.sample(range(len(v)), max(1, len(v) // draw.choice([60, 90]))):
            v[at] = "other"
        a, b = shingles(w), shingles(v)
        (near if len(a & b) / len(a | b) >= 0.8 else far).append((2 * k, 2 * k + 1))
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    passage = fresh(60)
    apart = range(1000, 1040)  # share a passage that is a third of each
    texts += [(i, " ".join(fresh(60) + passage + fresh(60))) for i in apart]
    texts += [(i, " ".join(fresh(6))) for i in range(2000, 2050)]  # two shingles each
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert len(near) > 100 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    assert all(got[i] == i for i in (*apart, *range(2000, 2050)))
    assert all(got[i] in (i, i - 1) for i in range(400))


def test_wide_trees_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    prints = np.unique(base[rng.integers(0, 6, 200)] ^ (np.uint64(1) << rng.integers(0, 63, (200, 4), dtype=np.uint64)), axis=0)
    n = len(prints)
    d = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2)
    label = np.arange(n)
    simhash.union(label, *np.nonzero(d <= 7))
    found = np.arange(n)
    simhash.union(found, *simhash.shard_links(np.zeros(n, np.int64), prints, np.full(n, 3), 7))
    assert (found == label).all() and len(set(label)) > 1


def test_near_duplicates_are_those_of_the_exact_sets(spark):
    import random

    draw = random.Random(5)
    fresh = lambda n: [f"u{draw.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(300):  # short pairs of 4 of 5, 7 of 10 and 12 of 15 shingles, longer ones of 0.7 and 0.82
        w, v = [((w := fresh(8)), w + fresh(1)), ((w := fresh(11)), w + fresh(3)), ((w := fresh(16)), w + fresh(3)), ((w := fresh(74)), w + fresh(30)), ((w := fresh(86)), w + fresh(18))][k % 5]
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts for w in [t.split()]}
    alike = lambda a, b: len(shingles[a] & shingles[b]) * 5 >= 4 * len(shingles[a] | shingles[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(300)] == [alike(2 * k, 2 * k + 1) for k in range(300)]
    assert all(got[2 * k] == 2 * k for k in range(300))


def test_large_groups_are_verified_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 400)
    base = [f"g{j}" for j in range(104)]  # 100 shingles
    texts = [(i, " ".join([*base[: 100 - i], *[f"x{i}y{j}" for j in range(4 + i)]])) for i in range(0, 60, 2)]
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts for w in [t.split()]}
    label = {i: i for i in shingles}
    for a in sorted(shingles):
        for b in sorted(shingles):
            if len(shingles[a] & shingles[b]) * 5 >= 4 * len(shingles[a] | shingles[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    found = simhash.near_duplicate_components(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == label and len(set(label.values())) > 1


def test_few_pairs_of_a_group_are_compared_by_their_sets(monkeypatch):
    """Texts that one tree proposes to one another, but which share less than is asked for: bits rule nearly all pairs out, and none that is similar."""
    import numpy as np

    rng = np.random.default_rng(4)
    base, sets = rng.integers(0, 1 << 63, 300, dtype=np.uint64), []
    for k in range(150):  # families of near copies, of which every other one is alone
        own = rng.integers(0, 1 << 63, 20 + 3 * (k % 40), dtype=np.uint64)
        sets += [np.unique(np.r_[base[len(own) :], own, own[: c % 5] + np.uint64(1)]) for c in range(1 + k % 2)]
    prints = np.array([simhash.wide_fingerprint(h)[0] for h in sets])
    sizes, values, n = np.array([len(h) for h in sets]), np.concatenate(sets), len(sets)
    alike = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2) <= simhash.NEAR
    label, compared, similar = np.arange(n), [], simhash.Sets.similar
    simhash.union(label, *np.nonzero(alike & near))
    monkeypatch.setattr(simhash.Sets, "similar", lambda self, a, b: compared.append(len(a)) or similar(self, a, b))
    found = np.arange(n)
    simhash.union(found, *simhash.shard_links(np.zeros(n, np.int64), prints, np.full(n, 3), simhash.NEAR, sizes, values))
    assert 0 < sum(compared) < (near.sum() - n) // 20 and (found == label).all() and 1 < len(set(label)) < n
    able = simhash.Sets(sizes, values).able(*np.nonzero(np.ones((n, n), bool))).reshape(n, n)
    assert able[alike].all()


def test_null_and_repeated_ids_lose_no_document(spark):
    text = lambda c, n=40: " ".join(f"{c}{j}" for j in range(n))
    x, y = text("x"), text("y")
    texts = [(3, x), (5, x), (5, y), (None, text("a")), (None, text("b")), (None, text("b") + " more"), (7, text("c")), (7, text("d")), (7, text("d"))]
    d = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id bigint, text string, source string")
    stays = lambda found: sorted((str(r["doc_id"]), r["text"].split()[0]) for r in found.collect())
    for parts in (1, 5):
        assert stays(simhash.drop_near_duplicates(d.repartition(parts))) == [("3", "x0"), ("5", "y0"), ("7", "c0"), ("7", "d0"), ("None", "a0"), ("None", "b0")]
    bench = spark.createDataFrame([(1, text("a", 20)), (2, text("c", 20))], "item_id bigint, text string")
    gone = [(3, "x0"), (5, "x0"), (5, "y0"), (7, "d0"), (7, "d0"), (None, "b0"), (None, "b0")]
    assert stays(decontaminate.drop_contaminated(d, bench)) == sorted((str(i), t) for i, t in gone)


def test_secrets_of_many_repositories_are_examples(spark):
    token, own = "Ab3dE5gH7jK9mN1pQ3sT5v", "Zb3dE5gH7jK9mN1pQ3sT5w"
    rows = [(i, f"{i} x {token} y password = hunter22", "one") for i in range(11)]  # eleven repositories of one owner
    rows += [(100 + i, f"x {own} y token = abc4567", "one") for i in range(30)]  # copies of one document
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r["doc_id"]: r for r in secrets.secret_spans(d).collect()}
    assert {(found[i]["n_live"], found[i]["n_example"], found[i]["n_base_live"]) for i in range(11)} == {(0, 1, 0)}
    assert {(found[100 + i]["n_live"], found[100 + i]["n_example"], found[100 + i]["n_base_live"]) for i in range(30)} == {(1, 0, 1)}
    assert found[0]["verdicts"] == "token:4:26:example:11:1,assign:29:48:example:11:1" and found[0]["spans"] == "assign:29:48"
    assert found[100]["verdicts"] == "token:2:24:live:1:1,assign:27:42:live:1:1" and found[100]["spans"] == "live:2:24,assign:27:42"


def test_short_items_and_every_run_are_found(spark):
    item = [f"b{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, "s0 s1 s2 s3 s4 s5 s6 s7"), (2, "t0 t1 t2"), (3, " ".join(item))], "item_id bigint, text string")
    spread = [w if i not in (4, 8, 11) else f"z{i}" for i, w in enumerate(item[:13])]  # 10 of 13 agree
    split = ["q"] * 30
    split[:12] = item[:12]  # a clean run of 12, then one of 16 with gaps
    split[13:29] = [w if i not in (3, 6, 9) else "z" for i, w in enumerate(item[13:29])]
    texts = [
        (1, "a s0 s1 s2 s3 s4 s5 s6 s7 b"), (2, "s0 x s2 s3 s4 s5 s6 y"), (3, "s0 x s2 s3 y s5 s6 z"), (4, "t0 t1 t2"), (5, "t0 t1 x"),
        (6, "c " + " ".join(spread)), (7, " ".join(split)), (8, " ".join(item[:12])),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), bench).collect()
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_overlap"]) for r in found}
    assert {k: v for k, v in got.items() if k[0] < 6} == {(1, 1): (8, 8), (2, 1): (6, 8), (4, 2): (3, 3)}
    a = lambda words: decontaminate.WordKeys().array(words)
    assert decontaminate.best_overlap(a(spread), a(item), 0) == (10, 0, 13)
    n, i, j = decontaminate.best_overlap(a(split), a(item), 0)
    assert j - i >= 13 and 4 * n >= 3 * (j - i) and (7, 3) in got and (8, 3) not in got
