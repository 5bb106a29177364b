"""The registered queries against plain Python over small tables or made-up rows; what is left of a corpus by value."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("etherloom.llm")
import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from etherloom.llm import bpe, decontaminate, langid, licenses, lines, quality, queries, secrets, simhash, substrings, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return {r["doc_id"]: r for r in rows}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op3_base_measures(spark, texts):
    found = by_id(queries.op3_line_frequency_rules(spark, SF))
    assert len(found) == len(texts)
    for i, r in texts.items():
        t = r["text"] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again))
        got = found[i]
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert got["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))


def test_op3_lines_and_depletion(spark):
    draw = random.Random(4)
    fresh = lambda n: " ".join("".join(draw.choices("abcdefgh", k=9)) for _ in range(n))
    # a menu on 25 pages of a host of 100, 12 words of which a poor page is mostly made; another host has it once
    menu, twelve = "Home | About us | Contact 2024 | terms and privacy of use", "follow us on every network that we are on now ok"
    rows = [(i, f"{menu}\n{fresh(30)}" if i < 25 else fresh(30), "big") for i in range(100)]
    rows += [(200, f"{menu.upper().replace('2024', '1999')}\n{fresh(9)}\n" + "\n".join(fresh(1) for _ in range(1)), "big"), (201, f"{menu}\n{fresh(12)}", "small")]
    rows += [(300 + k, f"{menu}\n{fresh(30)}", "big") for k in range(1)] * 40  # copies of one page count once
    rows += [(400 + k, f"{twelve}\n{fresh(25)}", "copies") for k in range(1)] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {}
    for r in quality.line_rules(d).collect():
        found.setdefault(r["doc_id"], r)
    size = len(WORD.findall(menu))
    assert found[0]["n_line_words_removed"] == size and found[0]["kept"]
    assert found[200]["n_line_words_removed"] == size and not found[200]["base_failed"] and not found[200]["kept"]  # depleted
    assert found[201]["n_line_words_removed"] == 0 and found[201]["kept"]
    assert found[300]["n_line_words_removed"] == size and found[400]["n_line_words_removed"] == 0
    # brute force of the rule with other limits, the absolute one too
    level = lambda x: re.sub(r"[0-9]+", "0", " ".join(WORD.findall(x)).lower())
    for limits in (dict(share=0.5, least=3, most=20), dict(share=0.2, least=30, most=1000)):
        pages, hosts = {}, Counter()
        for host, text in {(s, t) for _, t, s in rows}:
            hosts[host] += 1
            for x in {level(x) for x in text.split("\n") if WORD.search(x)}:
                pages[host, x] = pages.get((host, x), 0) + 1
        hot = {k for k, n in pages.items() if n >= limits["most"] or n >= limits["least"] and n > limits["share"] * hosts[k[0]]}
        gone = {(i, t): sum(len(WORD.findall(x)) for x in t.split("\n") if (s, level(x)) in hot) for i, t, s in rows}
        got = {r["doc_id"]: r["n_line_words_removed"] for r in quality.line_rules(d, **limits).collect()}
        assert got == {i: n for (i, _), n in gone.items()}


def test_op4_against_the_library(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.vocabulary())
    found = by_id(queries.op4_bpe_round_trip(spark, SF))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    ids = bpe.encode_documents(d, queries.vocabulary())
    encoded, decoded = by_id(ids), by_id(bpe.decode_documents(ids, queries.vocabulary()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, r in texts.items():
        wanted = lib.encode(r["text"] or "", add_special_tokens=False).ids
        back = lib.decode(wanted, skip_special_tokens=False)
        assert tuple(found[i])[:4] == (i, len(wanted), sha(" ".join(map(str, wanted))), sha(back))
        assert list(encoded[i]["ids"]) == wanted and decoded[i]["decoded"] == back


def test_op5_base_spans(spark, texts):
    kinds = {
        "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("(AKIA[A-Z0-9]+)"), "hex": re.compile("([0-9a-f]+)"),
    }
    least = {"assign": 6, "access": 20, "hex": 24}
    found = by_id(queries.op5_secret_ownership(spark, SF))
    for i, r in texts.items():
        spans, order = [], list(kinds)
        for k, p in kinds.items():
            spans += [(m.start(), order.index(k), m.end()) for m in p.finditer(r["text"] or "") if len(m[1]) >= least[k]]
        written = ",".join(f"{order[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert found[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in order] == [sum(x[1] == n for x in spans) for n in range(3)]
        assert set(written.split(",")) - {""} <= set(found[i]["spans"].split(","))


def test_op5_ownership(spark):
    draw = random.Random(9)
    token = lambda: "".join(draw.choices("abcdefghijkABCDEFGHIJK0123456789", k=30)) + "a1"
    rows, tokens = [], [token() for _ in range(30)]
    for i in range(400):
        x = tokens[min(29, int(draw.expovariate(0.15)))]
        rows.append((i, f"{i % 60} a {x} b", f"o{draw.randrange(1 + tokens.index(x) // 4)}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = by_id(secrets.secret_spans(d))
    for x in tokens:
        own = [r for r in rows if x in r[1]]
        if not own:
            continue
        owners, repos = len({r[2] for r in own}), len({r[1] for r in own})
        live = owners <= 2 and repos <= 10
        assert {(found[r[0]]["n_live"], found[r[0]]["n_example"]) for r in own} == {(int(live), int(not live))}
        assert {found[r[0]]["verdicts"].split(":", 3)[3] for r in own} == {f"{'live' if live else 'example'}:{repos}:{owners}"}


def test_op6_of_whole_table(spark, texts, monkeypatch):
    found = by_id(queries.op6_count_min_substrings(spark, SF))
    first, words = {}, {i: WORD.findall(texts[i]["text"] or "") for i in sorted(texts)}
    for i, w in words.items():
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k) for j in range(k, k + 20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert tuple(found[i])[:4] == (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    # many chunks and slices, small segments: the same rows
    for name, value in (("CHUNK", 20_000), ("SLICE", 256), ("SEGMENT", 64), ("BLOCK", 512)):
        monkeypatch.setattr(substrings, name, value)
    monkeypatch.setattr(substrings, "_HASHES", [])
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")  # a smaller table, not a smaller query
    first = {}
    for i in sorted(words):
        if i % 4 == 0:
            for k in range(len(words[i]) - 19):
                first.setdefault(tuple(words[i][k : k + 20]), (i, k))
    got = by_id(substrings.remove_repeats(d))
    for i, r in got.items():
        w = words[i]
        assert r["n_removed"] == len({j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k) for j in range(k, k + 20)})


def test_op6_load_of_the_sketch_is_fixed():
    draw = np.random.default_rng(1)
    import pyarrow as pa

    for slices in (1, 4):  # as many minimizers a slice: the share taken for repeated by mistake stays
        n = slices * substrings.SLICE // 4
        anchors = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        chunks = np.array_split(anchors, 5)
        pieces = [substrings.chunk_sketch(k, x, slices) for k, x in enumerate(chunks)]
        table = pa.concat_tables([pa.table({c: p[c] for c in p}) for p in pieces])
        answers = pa.concat_tables([pa.table(substrings.merged_slice(table.filter(pa.compute.equal(table["slice"], s)))) for s in range(slices)])
        told = [substrings.repeated(x, answers.filter(pa.compute.equal(answers["chunk"], k)), slices) for k, x in enumerate(chunks)]
        assert np.concatenate(told).mean() < 0.005
    twice = [np.unique(np.concatenate([chunks[0][:50], chunks[1]])), chunks[0]]
    pieces = [substrings.chunk_sketch(k, x, slices) for k, x in enumerate(twice)]
    table = pa.concat_tables([pa.table({c: p[c] for c in p}) for p in pieces])
    answers = pa.concat_tables([pa.table(substrings.merged_slice(table.filter(pa.compute.equal(table["slice"], s)))) for s in range(slices)])
    for k, x in enumerate(twice):
        assert substrings.repeated(x, answers.filter(pa.compute.equal(answers["chunk"], k)), slices)[np.isin(x, chunks[0][:50])].all()


def test_op6_rows_that_share_a_key_and_order(spark):
    w = [f"q{i}" for i in range(25)]
    rows = [(3, " ".join(w)), (None, "x " + " ".join(w)), (1, None), (2, "  "), (5, " ".join(w)), (5, " ".join(w)), (7, "a b c " * 20)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("3", 25, 25), ("None", 26, 0), ("1", 0, 0), ("2", 0, 0), ("5", 25, 25), ("5", 25, 25), ("7", 60, 57)])
    same = spark.createDataFrame([(5, " ".join(w))] * 3, "doc_id long, text string")
    assert {r["n_removed"] for r in substrings.remove_repeats(same).collect()} == {0}  # identical rows are one place


def fingerprint(text):
    import xxhash

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op7_fingerprints_and_components(spark, texts):
    prints = {i: fingerprint(r["text"]) for i, r in texts.items()}
    label = {i: i for i in prints}
    root = lambda i: i if label[i] == i else root(label[i])
    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    found = by_id(queries.op7_simhash_bk_trees(spark, SF))
    assert {i: tuple(r)[1:3] for i, r in found.items()} == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_op8_contract(spark, texts):
    found = by_id(queries.op8_viterbi_language(spark, SF))
    assert {i: r["held_out"] for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    known = {r["lang"] for r in texts.values() if r["lang"]}
    for i, r in found.items():
        none = not any(c.isalpha() for c in texts[i]["text"] or "")
        assert (r["lang_pred"] == "und") == none and r["lang_pred"] in known | {"und"} and 0 <= r["score"] <= 1
    hidden = [i for i, r in found.items() if r["held_out"] and texts[i]["lang"]]
    assert sum(found[i]["lang_pred"] == texts[i]["lang"] for i in hidden) >= 0.95 * len(hidden)


def test_op8_letters_rare_languages_and_spans(spark):
    assert langid.letters("½ ² x² 12 _ Ⅷ") == ["x"] and langid.letters("一二 é") == ["一二", "é"]
    draw = random.Random(2)
    word = {"aa": "bado keli mufo sana toru".split(), "bb": "chyx phrez whisk thwyl ngyth".split(), "cc": ["слово", "буква", "речка"]}
    rows = [(i, " ".join(draw.choices(word["aa"], k=60)), "aa") for i in range(400)] + [(1000 + i, " ".join(draw.choices(word[g], k=20)), g) for g in ("bb", "cc") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d.select("text", "lang"), sample=50)
    assert model["langs"] == ["aa", "bb", "cc"] and list(model["scripts"]["Cyrillic"]) == [False, False, True]
    mixed = spark.createDataFrame([(1, " ".join(draw.choices(word["aa"], k=30) + draw.choices(word["bb"], k=30) + draw.choices(word["cc"], k=5))), (2, "½ ²"), (3, None)], "doc_id long, text string")
    got = by_id(langid.identify(mixed, model))
    assert [(s["first_word"], s["n_words"], s["lang"]) for s in got[1]["spans"]] == [(0, 30, "aa"), (30, 30, "bb"), (60, 5, "cc")]
    assert (got[2]["lang_pred"], got[2]["score"], got[3]["lang_pred"]) == ("und", 0.0, "und")
    empty = langid.fit(d.where("false"))
    assert {r["lang_pred"] for r in langid.identify(mixed, empty).collect()} == {"und"} and langid.keep_identified(mixed, empty).count() == 0


def test_op9_base_columns(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = by_id(queries.op9_diagonal_licenses(spark, SF))
    for i, r in texts.items():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        at = {g: [k for k in range(len(w)) if tuple(w[k : k + len(p)]) == p] for g, p in licenses.PHRASES.items()}
        every = [k for x in at.values() for k in x]
        base = ",".join(sorted(g for g, x in at.items() if x))
        got = found[i]
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(w), len(every), base)
        assert (got["first_word"], got["last_word"]) == ((min(every), max(every)) if every else (None, None))
        assert set(base.split(",")) <= set(got["labels"].split(","))


def test_op9_templates_edits_and_lookalikes(spark):
    draw = random.Random(6)
    noise = lambda n: " ".join(f"k{draw.randrange(10**6)}" for _ in range(n))
    names, rows = sorted(licenses.TEMPLATES), []
    for k, name in enumerate(names):
        body = licenses.TEMPLATES[name].split()
        rows.append((k, f"{noise(30)}\n{' '.join(body).title()}, {noise(20)}"))
        if len(body) > 60:  # one word in 25 changed, a word put in, one left out
            edited = [f"e{j}" if j % 25 == 7 else x for j, x in enumerate(body)]
            rows.append((100 + k, " ".join([*edited[:30], "very", *edited[30:50], *edited[51:]])))
            rows.append((200 + k, " ".join(x if j % 3 else f"n{j}" for j, x in enumerate(body))))  # every third word: not the text
            rows.append((300 + k, " ".join(f"{' '.join(body[j : j + 5])} {noise(40)}" for j in range(0, len(body), 5))))  # scattered
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in licenses.license_runs(d).collect():
        found.setdefault(r["doc_id"], {})[r["label"]] = r
    for k, name in enumerate(names):
        size = len(licenses.TEMPLATES[name].split())
        assert (found[k][name]["score"], found[k][name]["equal"], found[k][name]["first"], found[k][name]["last"]) == (1.0, size, 30, 29 + size)
        if size > 60:
            assert found[100 + k][name]["score"] >= 0.8 and 200 + k not in found and name not in found.get(300 + k, {})


def brute_overlaps(doc, item):
    """Whether some diagonal has 13 tokens from a match to a match, or the whole item, of which 3 in 4 agree."""
    a, b = decontaminate.tokens(doc), decontaminate.tokens(item)
    for g in range(-len(b) + 1, len(a)):
        low, high = max(0, -g), min(len(b), len(a) - g)
        same = [a[k + g] == b[k] for k in range(low, high)]
        if len(same) == len(b) and 4 * sum(same) >= 3 * len(same):
            return True
        for i in range(len(same)):
            for j in range(i + 13, len(same) + 1):
                if same[i] and same[j - 1] and 4 * sum(same[i:j]) >= 3 * (j - i):
                    return True
    return False


def test_op2_recall_by_substitutions(spark):
    draw = random.Random(7)
    items = {n: [f"i{n}w{k}" for k in range(L)] for n, L in enumerate([13, 13, 13, 16, 20, 20, 30, 50] * 2)}
    wanted = {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 5, 6: 7, 7: 12}
    rows, planted = [], {}
    for k in range(480):
        n = k % 16
        w = list(items[n])
        for at in draw.sample(range(len(w)), wanted[n % 8]):
            w[at] = f"s{k}x{at}"
        rows.append((k, " ".join([f"p{k}"] * draw.randrange(5) + w + [f"q{k}"] * 5)))
        planted[k] = n
    rows += [(1000 + n, " ".join(f"c{n}" if j % 3 == 1 else x for j, x in enumerate(w))) for n, w in items.items()]  # 2 in 3 agree
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    truth = {(i, n) for i, t in rows for n, w in items.items() if set(w) & set(t.split()) and brute_overlaps(t, " ".join(w))}
    assert found <= truth and {(k, n) for k, n in planted.items()} <= truth and not any(i >= 1000 for i, _ in truth)
    for level in range(8):
        own = [(k, n) for k, n in planted.items() if n % 8 == level]
        assert sum(x in found for x in own) >= 0.85 * len(own)  # 60 each; 1500 placements gave 0.92 at the least
    assert len(found & set(planted.items())) >= 0.95 * len(planted)


def test_op2_ids_ties_and_filter(spark):
    w = [f"t{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(w)), (1, "u1 u2 u3 u4 u5 u6 u7 u8 u9"), (None, " ".join(w)), (4, None), (5, "")], "item_id long, text string")
    rows = [(7, " ".join(w)), (7, "other"), (None, "u1 u2 u3 u4 u5 u6 u7 u8 u9"), (8, " ".join(w + w)), (9, None)]
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["n_overlap"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert found == [("7", "1", 20), ("7", "None", 20), ("8", "1", 20), ("8", "None", 20), ("None", "1", 9)]
    assert decontaminate.filter_bits(0) == 16 and decontaminate.filter_bits(10**6) == 26 and decontaminate.filter_bits(10**9) == decontaminate.MOST_BITS


def test_op10_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    found, wanted = queries.op10_site_line_dedup(spark, "/root/testdata/sf0.01"), con.sql(queries.ORACLE["op10_site_line_dedup"])
    at = [wanted.columns.index(c) for c in found.columns]
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(tuple(x[i] for i in at) for x in wanted.fetchall()) and any(r[2] for r in rows)


def test_op1_probabilities_are_out_of_fold_and_in_order(spark, monkeypatch):
    seen = []
    train, predict = toxicity.Linear.train, toxicity.Linear.predict

    def watch_train(rows, keys, n, dense, y):
        model = train(rows, keys, n, dense, y)
        seen.append(("train", model, {k for k in keys.tolist() if k >= 0}, dense.copy(), n))
        return model

    def watch_predict(self, rows, keys, n, dense):
        out = predict(self, rows, keys, n, dense)
        seen.append(("predict", self, {k for k in keys.tolist() if k >= 0}, out.copy(), n))
        return out

    monkeypatch.setattr(toxicity.Linear, "train", staticmethod(watch_train))
    monkeypatch.setattr(toxicity.Linear, "predict", watch_predict)
    draw = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        low, toxic = draw.random() < 0.4, False
        toxic = low and draw.random() < 0.6
        docs.append((i, f"own{i} " + " ".join(draw.choices(["junk", "spam"] if low else ["good", "fine"], k=5) + draw.choices(["vile"] if toxic else ["mild"], k=2))))
        labels.append((i, int(not low), int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(d, lab, {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert chain["names"] == ["low", "toxic"]
    steps = [s[0] for s in seen]
    per = toxicity.FOLDS * 2 + 1
    assert steps == (["train", "predict"] * toxicity.FOLDS + ["train"]) * 2
    own = {int(k) for k in (toxicity.WordKeys().array([f"own{i}" for i in range(600)]).view(np.int64)) if k >= 0}
    for c in range(2):
        for k in range(toxicity.FOLDS):
            learn, test = seen[c * per + 2 * k], seen[c * per + 2 * k + 1]
            assert test[1] is learn[1] and not (learn[2] & own) & (test[2] & own) and learn[4] + test[4] == 600  # no row by a model that saw it
    assert seen[0][3].shape[1] == 0 and seen[per][3].shape[1] == 1  # the second category has the first one's probability
    apart = np.concatenate([seen[2 * k + 1][3] for k in range(toxicity.FOLDS)])
    fold = np.concatenate([np.flatnonzero(np.arange(600) % toxicity.FOLDS == k) for k in range(toxicity.FOLDS)])
    p = np.empty(600)
    p[fold] = apart
    assert np.allclose(seen[2 * per - 1][3][:, 0], np.log(p + 1e-6) - np.log(1 - p + 1e-6))
    got = by_id(toxicity.score_chain(d, chain))
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in labels) >= 0.97 * 600
    none = toxicity.toxicity(d, lab.where("false"))
    assert none.count() == 600 and none.where("toxic").count() == 0  # no labels: nothing is toxic


def test_op1_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = toxicity.toxicity(d, lab.where(~hidden)).join(lab.where(hidden).withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    right = [r["toxic"] == bool(r["is_toxic"]) for r in found]
    toxic = [r["toxic"] for r in found if r["is_toxic"]]
    assert sum(right) >= 0.97 * len(right) and sum(toxic) >= 0.85 * len(toxic) > 50


CLASH = ("__bad", "__n", "__stays", "__frequent", "__source", "__node", "__row", "__hot", "__way", "host", "page", "keys", "copy", "row", "doc", "fp", "w", "n")


def test_columns_named_like_internals_and_values_of_edge_rows(spark):
    long = " ".join(f"long{k % 5000}q{k // 7}" for k in range(60_000))
    many = "\n".join(f"line number {'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]}" for k in range(10_000))
    base = [(1, long), (2, long), (2, long), (3, many), (4, None), (5, ""), (None, "no id here at all"), (None, "no id here at all")]
    rows = [(i, t, "en", "s", 1, *["x"] * len(CLASH)) for i, t in base]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    d = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, "no id here at all"), (2, None)], "item_id long, text string")
    model = langid.fit(d.select("text", "lang"))
    kept = {
        "identified": langid.keep_identified(d, model), "lines": lines.drop_frequent_lines(d), "unique": simhash.drop_near_duplicates(d),
        "clean": decontaminate.drop_contaminated(d, bench),
    }
    ids = lambda f: sorted(str(r["doc_id"]) for r in f.collect())
    assert all(f.columns == d.columns for f in kept.values())
    assert ids(kept["identified"]) == ["1", "2", "2", "3", "None", "None"] and ids(kept["lines"]) == sorted(str(i) for i, _ in base)
    assert ids(kept["unique"]) == ["1", "3", "4", "None"] and ids(kept["clean"]) == ["1", "2", "2", "3", "4", "5"]
    assert {r["doc_id"]: r["text"] for r in kept["lines"].where("doc_id IN (1, 3, 4, 5)").collect()} == {1: long, 3: many, 4: None, 5: ""}
    gone = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(d).collect())
    assert gone == sorted([("1", 60_000, 0), ("2", 60_000, 60_000), ("2", 60_000, 60_000), ("3", 30_000, 0), ("4", 0, 0), ("5", 0, 0), ("None", 5, 0), ("None", 5, 0)])
    rules = {r["doc_id"]: r for r in quality.line_rules(d).collect()}
    assert (rules[3]["n_words"], rules[3]["n_dup_lines"], rules[3]["kept"]) == (30_000, 0, True) and (rules[4]["n_words"], rules[4]["kept"]) == (0, False)
    spans = {r["doc_id"]: r for r in secrets.secret_spans(d).collect()}
    assert {spans[i]["spans"] for i in (1, 4, 5)} == {""} and spans[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    found = {r["doc_id"]: r for r in licenses.license_labels(d).collect()}
    assert (found[3]["n_words"], found[3]["n_base"], found[3]["first_word"], found[3]["labels"], found[3]["score"]) == (30_000, 0, None, "", 0.0) and found[4]["n_words"] == 0
    tokens = {r["doc_id"]: r for r in bpe.digest_documents(d, queries.vocabulary()).collect()}
    assert (tokens[4]["n_tokens"], tokens[5]["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest()) and tokens[1]["n_tokens"] > 60_000
    prints = {r["doc_id"]: r for r in simhash.simhash_components(d).collect()}
    assert prints[4]["fingerprint"] == prints[5]["fingerprint"] == "0" * 16 and prints[5]["component_id"] == 4 and prints[2]["component_id"] == 1
    toxic = toxicity.toxicity(d, spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxic.count() == len(base) and {r["toxic"] for r in toxic.collect()} <= {True, False}


def test_language_and_chain_ties(spark):
    assert langid.viterbi(np.zeros((30, 3))).tolist() == [0] * 30  # the first label of equals
    assert toxicity.best_threshold(np.array([0.5, 0.5, 0.5]), np.array([1.0, 0.0, 1.0])) < 0.5  # equal probabilities stand together


def test_pipeline_against_brute_force(spark, texts, tmp_path):
    """run() over the whole small tables: each stage by plain Python on what the one before it kept."""
    import os
    import sys

    pipeline = pytest.importorskip("corpus_pipeline")
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) if spark.conf.get("spark.checkpoint.dir", None) else set()
    result = by_id(pipeline.run(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, held = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        held.append([tuple(r) for r in now.select(*pipeline.COLUMNS).collect()])
        assert now.columns == list(pipeline.COLUMNS) == docs.columns
        now = spark.createDataFrame(held[-1], docs.schema)
    first, second, third, fourth = held
    # language ID keeps clean documents: rejects only texts without a letter, or of mixed languages
    lost = [r for i, r in texts.items() if i not in {x[0] for x in first}]
    assert len(first) + len(lost) == len(texts) and len(lost) < 0.1 * len(texts)
    assert all(not any(c.isalpha() for c in r["text"] or "") or len(r["text"]) < 2000 for r in lost)
    # line dedup: pages are distinct texts of a host
    pages = {(r[3], r[1]) for r in first}
    total, count = Counter(s for s, _ in pages), Counter()
    cut = lambda x: x.strip(" \t\r")
    for s, t in pages:
        count.update({(s, cut(x)) for x in (t or "").split("\n") if cut(x)})
    hot = {k for k, n in count.items() if n >= 10 and n > 0.05 * total[k[0]]}
    clean = lambda s, t: "\n".join(x for x in t.split("\n") if (s, cut(x)) not in hot)
    assert sorted(second) == sorted((i, clean(s, t), g, s, n) for i, t, g, s, n in first)
    # near-duplicates: Jaccard 0.8 of five-word shingles, one of each component
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = sorted(second, key=lambda r: r[0])
    sets, label = [shingles(r[1]) for r in rows], list(range(len(rows)))
    root = lambda i: i if label[i] == i else root(label[i])
    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    assert sorted(third) == sorted(rows[i] for i in range(len(rows)) if root(i) == i)
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokens = [set(decontaminate.tokens(b)) for b in bench]

    def leaked(t):
        w = set(decontaminate.tokens(t))
        return any(len(w & x) >= 9 and brute_overlaps(t, b) for x, b in zip(tokens, bench))

    gone = {r[0] for r in third} - {r[0] for r in fourth}
    assert gone == {r[0] for r in third if leaked(r[1])} and all(r in third for r in fourth)
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.vocabulary())
    assert result.keys() == {r[0] for r in fourth}
    for i, t, *_ in fourth:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert result[i]["n_tokens"] == len(ids) and result[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sys.modules["corpus_pipeline"].STAGES[-1][0].startswith("BPE")
    if before:  # run() leaves its result only
        assert len({x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("etherloom-stage")} - before) == 1
