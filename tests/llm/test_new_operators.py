"""Whitening, MinHash near-duplicates and the source audit against plain Python, and their edge rows by value."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("etherloom.llm")
import numpy as np  # noqa: E402

from etherloom.llm import audit, decontaminate, minhash, queries, substrings, whiten  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def test_pipeline_of_empty_tables_and_of_texts_without_words(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, rows in (("none", docs.limit(0)), ("blank", spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0), (1, " \n", "en", "a", 2)], docs.schema))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / name / "benchmark.parquet"))
        found = pipeline.run(spark, str(tmp_path / name))
        assert found.collect() == [] and "ids_sha256" in found.columns  # without a letter there is no language


def plain_whitening(rows):
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in rows}
    once = np.array(sorted(set(map(tuple, x.values()))))
    n, sums = len(once), once.sum(axis=0)
    c = once - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, e[::-1], v[:, ::-1]


def test_op11_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x, n, sums, e, v = plain_whitening(rows)
    found = queries.op11_embedding_whitening(spark, SF).collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        k, own = r["component"] - 1, np.array(x[r["vec_id"]])
        assert r["n"] == n and r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums)) == int(r["deviation_exact"])
        assert abs(abs(r["whitened"]) - abs((own - sums / n) @ v[:, k] / np.sqrt(e[k]))) < 1e-9
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9
    signs = defaultdict(set)
    for r in found:
        k = r["component"] - 1
        signs[k].add(np.sign(r["whitened"] * ((np.array(x[r["vec_id"]]) - sums / n) @ v[:, k])))
    assert all(len(s - {0.0}) == 1 for s in signs.values())


def test_op11_edges(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1), draw.gauss(0, 2), draw.gauss(0, 3)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0]), (105, [])]
    again = [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1])]
    schema = "vec_id long, embedding array<double>, n long, x string, component int"
    d = spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows + odd + again], schema)
    found = whiten.whiten(d).collect()
    x, n, sums, e, v = plain_whitening(rows)
    assert len(found) == 3 * 43 and {r["n"] for r in found} == {40}  # three dimensions have three components
    assert {r["vec_id"] for r in found} == {*range(40), 200, None}
    mine = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert all(mine[200, k] == mine[0, k] and mine[None, k] == mine[1, k] for k in (1, 2, 3))
    assert all(abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 for r in found)
    # vectors on a line have one component, equal ones none, and so have no rows
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id int, embedding array<float>")
    assert {r["component"] for r in whiten.whiten(line).collect()} == {1}
    for none in (line.where("vec_id = 3"), line.where("false"), line.selectExpr("vec_id", "cast(array() as array<float>) AS embedding")):
        assert whiten.whiten(none).collect() == []
    # entries so large that sums and squares exceed a long
    large = spark.createDataFrame([(i, [float(10**14 * i), float(i * i)]) for i in range(-3, 4)], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r for r in whiten.whiten(large, components=1).collect()}
    assert got[3]["deviation"] is None and int(got[3]["deviation_exact"]) == (7 * 256 * 3 * 10**14) ** 2 + (7 * 256 * 9 - 256 * 28) ** 2
    assert abs(got[3]["whitened"]) == pytest.approx(1.5)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(sets):
    """From name -> set: the least name that each reaches over pairs of 100 * common >= 85 * all."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}


def test_op12_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    wanted = plain_components(sets)
    found = queries.op12_minhash_stars(spark, SF).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {
        (i, len(s), wanted[i], wanted[i] == i) for i, s in sets.items()
    } and len(found) == len(sets)


@pytest.fixture(scope="module")
def families():
    """Groups around a base, in which members are similar to the base but often not to one another; lone relatives below the limit."""
    draw, rows = random.Random(5), []
    word = lambda: "".join(draw.choices("abcdefghijkl", k=6))
    for _ in range(25):
        base = [word() for _ in range(draw.choice((6, 60, 61, 120, 200, 300)))]
        rows.append(base)
        for _ in range(draw.choice((1, 3, 30, 30))):
            copy = list(base)
            for _ in range(draw.choice((1, 1, 1, 2, 3, 9))):
                copy[draw.randrange(len(copy))] = word()
            rows.append(copy + [word() for _ in range(draw.choice((0, 0, 1, 2)))])
    passage = [word() for _ in range(60)]
    rows += [passage + [word() for _ in range(k)] for k in range(60)]  # a chain in a bucket of texts that are not all similar
    draw.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("stars, sets", [(20_000, 1_000_000), (7, 500)])
def test_op12_groups_and_pieces(spark, families, monkeypatch, stars, sets):
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "SETS", sets)
    wanted = plain_components({i: shingles(t) for i, t in families})
    assert 40 < len(set(wanted.values())) < len(families) - 100
    found = minhash.near_duplicates(spark.createDataFrame(families, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_op12_edges(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (None, long), (8, long.upper()), (8, long), (9, "É x"), (10, "é x"), (None, "own"), (None, "own"), (2, "")]
    d = spark.createDataFrame([(i, t, 1, "a", 2, "b") for i, t in rows], "doc_id long, text string, node int, id string, size int, bucket string")
    found = [(str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d).collect()]
    wanted = [("1", 0, 1, True), ("2", 0, 2, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 1, 4, True), ("5", 1, 4, False), ("6", 1, 6, True)]
    wanted += [("None", 46, 8, False), ("8", 46, 8, True), ("8", 46, 8, True), ("9", 1, 9, True), ("10", 1, 10, True)] + [("None", 1, None, True)] * 2
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    assert minhash.near_duplicates(d.where("false")).collect() == []


def test_one_permutation_bins_agree_with_the_similarity():
    draw = np.random.default_rng(1)
    for size in (3, 7, 30, 400):
        agree = []
        for _ in range(400):
            h = np.unique(draw.integers(0, 1 << 63, size + 1, dtype=np.uint64))
            agree.append((minhash.signature(h) == minhash.signature(h[:-1])).mean())
        assert abs(np.mean(agree) - size / (size + 1)) < 0.02
    assert (minhash.signature(np.array([5], np.uint64)) == minhash.signature(np.array([5], np.uint64))).all()


def plain_audit(rows, least, top=50):
    """From (text, lang, source): the rows that the contract names."""
    count, within, groups = Counter(), defaultdict(set), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            count[lang, source, t] += 1
            within[lang, t].add(k)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in within.items() if x == lang and len(d) >= least]
        own = sorted(s for x, s in groups if x == lang)

        def p(counts):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        of = {s: {t: count[lang, s, t] for t in kept} for s in own}
        q, ps = p({t: sum(of[s][t] for s in own) for t in kept}), {s: p(of[s]) for s in own}
        for s in own:
            pairs = [(u, sum(abs(ps[s][t] - ps[u][t]) for t in kept)) for u in own if u != s]
            above = [(t, ps[s][t] - q[t]) for t in kept if of[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:most])]
    return sorted(out)


def audited(df, **options):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in audit.source_divergence(df, **options).collect())


@pytest.mark.parametrize("entries, cells", [(500_000, 4_000_000), (50, 12)])
def test_op13_equals_plain_python(spark, monkeypatch, entries, cells):
    monkeypatch.setattr(audit, "ENTRIES", entries)
    monkeypatch.setattr(audit, "CELLS", cells)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source")
    wanted = plain_audit([tuple(r) for r in docs.collect()], 30)
    assert audited(docs) == wanted and {r[2] for r in wanted} == {"pair", "term"}
    assert audited(docs, least=3, ways=3) == plain_audit([tuple(r) for r in docs.collect()], 3)


def test_op13_edges(spark):
    rows = [(None, None, None), ("", "en", "a"), ("Straße ÉTÉ été x1y ab_cd", "en", "b"), ("x x\x00X\ny " * 50, "en", "b"), ("x y", "en", "c"), ("日本 x", "ja", "only"), ("x y", None, "z")]
    rows += [("x y", "en", "c")] * 3
    d = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n int, term string, size int")
    for least in (1, 2, 4, 99):
        assert audited(d, least=least) == plain_audit(rows, least)
    assert audited(d.where("false")) == []


def test_probabilities_beyond_64_bits():
    count, total = [5, 10**12 + 5, 123456789012, 7], [10**13, 10**12 + 5, 987654321098765, 8]
    found = audit.probability(np.array(count), np.array(total))
    assert found.tolist() == [1 + 10**9 * c // t for c, t in zip(count, total)]


def test_op6_chunks_and_slices_grow_together():
    sizes = [0, 10**8, 3 * 10**10, 10**12, 10**13, 6 * 10**13]
    found = [substrings.loads(x) for x in sizes]
    assert found[0] == (substrings.CHUNK, substrings.SLICE, 1, 1) and found[2][:2] == found[0][:2]
    for (chunk, load, chunks, slices), size in zip(found[2:], sizes[2:]):
        assert abs(chunk / load - substrings.CHUNK / substrings.SLICE) < 0.01  # together
        assert chunks * slices < 1.2 * size / 900  # a row for some 1 kB of text, at any size
        assert load / chunks > 10  # a chunk's sketch has more than a few cells in a slice
    assert substrings.loads(10**14)[:2] == (substrings.MOST * substrings.CHUNK, substrings.MOST * substrings.SLICE)
    empty = substrings.chunk_sketch(3, np.array([1 << 63], np.uint64), 1000, 64)
    assert len(empty["slice"]) == 1 and len(empty["cells0"]) == 1  # slices that it does not touch have no piece


def test_op2_phrases_of_many_items(spark, monkeypatch):
    draw = random.Random(2)
    fresh = lambda n: ["".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    frame = fresh(11)  # below LEAST: no overlap by itself
    items = [fresh(30) + frame + fresh(30) for _ in range(300)]
    docs = [fresh(40) + frame + fresh(40) for _ in range(300)]
    real = {}
    for k in range(40):  # the frame and what stands beside it, with substitutions
        n = draw.randrange(300)
        part = list(items[n][30 - k % 3 : 44])
        for at in draw.sample(range(1, len(part) - 1), 3 if len(part) > 14 else 2):
            part[at] = fresh(1)[0]
        real[len(docs)] = n
        docs.append(fresh(20) + part + fresh(20))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(docs)], "doc_id long, text string")
    seen = []
    pairs = decontaminate.candidate_pairs
    monkeypatch.setattr(decontaminate, "candidate_pairs", lambda *a: seen.append(pairs(*a)) or seen[0])
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()}
    assert seen[0].count() <= 600
    assert not any(i < 300 for i, _ in found)
    assert len({x for x in real.items() if x in found}) >= 0.9 * len(real) and all(real[i] == n for i, n in found)
    # with every seed joined as it is, the same is found
    monkeypatch.setattr(decontaminate, "FEW", 10**9)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()} >= found
