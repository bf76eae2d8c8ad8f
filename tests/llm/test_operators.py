"""The training-data operators against brute force, with null, empty, repeated, tied and very long rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import bpe, common, decontaminate, exact_dedup, language_id, licenses, line_dedup, near_dedup, ngram_lm, quality, token_counts
from tabulon.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, keep string, h string"
R = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(120)
NEAR = BASE.replace(BASE.split()[60], "changed")
LONG = prose(30_000)
TEXTS = [BASE, BASE, BASE.replace(" ", "\n", 3).upper(), NEAR, None, None, "", "  \t", "one", "one two", "ONE  two", "a\x00b c", LONG, LONG + " tail", "日本語 É é ß Σ <|endoftext|> it's", "x" * 20_000, "Released under the MIT License.", "MIT - license, gnu GENERAL public\nlicense; apache license!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 1, "i", "k", "h") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_library_s(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    alphabet = "ab the's 'll don't İΣςß\x1c\x85\xa0　éé 1²ⅷñ!?\n\t<|endoftext|>日本😀 x'RE"
    texts = [x or "" for x in TEXTS] + ["".join(R.choice(alphabet) for _ in range(R.randint(0, 40))) for _ in range(800)]
    own = bpe.TrieBpe(vocabulary(name))
    got = [np.frombuffer(x, np.int32) for x in own.encode_batch(texts)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want
    offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
    decoded = bpe.Decoder(vocabulary(name)).decode_batch(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(got))))
    assert decoded.to_pylist() == [t.decode(w, skip_special_tokens=False) for w in want]


def test_bpe_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    own, large = bpe.TrieBpe(vocabulary("word_bpe_49k.json")), [prose(30) for _ in range(20)]
    first = own.encode_batch(large)
    assert first == own.encode_batch(large) and all(first)


def test_bpe_query(docs):
    got = bpe.bpe_digests(docs, vocabulary("word_bpe_49k.json")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == docs.count() and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (4, 6, 7))
    assert bpe.bpe_digests(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_token_counts_follow_edits():
    t = bpe.tokenizer(vocabulary("byte_bpe_50k.json"))
    alphabet = "ab cd  \n\t'll's 12!é"
    for trial in range(120):
        text = "".join(R.choice(alphabet) for _ in range(R.randint(0, 900)))
        tree = token_counts.CountTree(t, text)
        for _ in range(4):
            a = R.randint(0, len(text) + 3)
            b, new = a + R.randint(0, 30), "".join(R.choice(alphabet) for _ in range(R.randint(0, 12)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text
        words = t.pattern.findall(text)
        assert (tree.pieces[1], tree.tokens[1]) == (len(words), sum(token_counts.counts_of(t, words))), trial


def test_token_counts_query(docs):
    held = docs.withColumn("edits", token_counts.stated_edits())
    rows = token_counts.token_counts(held, vocabulary("byte_bpe_50k.json")).collect()
    assert len(rows) == docs.count()
    long = next(r for r in rows if r.doc_id == 12)
    assert 0 < long.n_reencoded < long.n_pretokens / 20
    none = token_counts.token_counts(docs.withColumn("edits", F.lit(None).cast(token_counts.EDITS)), vocabulary("byte_bpe_50k.json")).collect()
    assert all(r.n_tokens == r.n_tokens_after for r in none)


def brute_counts(t, text):
    words = t.pattern.findall(text)
    return len(words), sum(len(x) // 4 for w in words for x in t.encode_words([t.symbols(w)]).values())


def test_token_counts_from_stored_trees(spark, docs):
    """Chains of edits, each from the trees that the one before left, against counting whole texts anew."""
    path = vocabulary("byte_bpe_50k.json")
    t, alphabet = bpe.tokenizer(path), "ab cd  \n\t'll's 12!é"
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    texts |= {100 + i: "".join(R.choice(alphabet) for _ in range(R.randint(0, 3_000))) for i in range(25)}
    trees = token_counts.count_trees(spark.createDataFrame([(i, x, 0) for i, x in texts.items()] + [(None, "no id", 0)], "doc_id long, text string, tokens int"), path)
    for _ in range(3):
        changes, new = {}, dict(texts)
        for i in R.sample(sorted(texts), 20):
            one = []
            for _ in range(2):
                a, x = R.randint(0, len(new[i]) + 3), "".join(R.choice(alphabet) for _ in range(R.randint(0, 12)))
                b = a + R.randint(0, 30)
                one += [{"start": a, "stop": b, "insert": x}, {"start": None, "stop": 3, "insert": "lost"}, None]
                new[i] = new[i][:a] + x + new[i][b:]
            changes[i] = one
        edits = spark.createDataFrame([(i, x) for i, x in changes.items()] + [(None, None), (9_999, None)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("edits", token_counts.EDITS)]))
        trees = token_counts.edit_trees(trees, edits, path).persist()
        got = by_id(trees)
        assert set(got) == {*texts, None}
        for i, x in new.items():
            r = got[i]
            assert "".join(leaf.text for leaf in r.leaves) == x and (r.n_pretokens, r.n_tokens) == brute_counts(t, x), i
            assert [len(leaf.text) for leaf in r.leaves] == [leaf.chars for leaf in r.leaves] and sum(leaf.tokens for leaf in r.leaves) == r.n_tokens
            assert i in changes or r.n_reencoded == 0
        assert all(got[i].n_reencoded < got[i].n_pretokens / 10 for i in changes if len(new[i]) > 100_000)
        texts = new
    assert token_counts.count_trees(docs.limit(0), path).count() == 0 == token_counts.edit_trees(trees.limit(0), edits, path).count()


def test_token_counts_of_unbroken_text(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTS_HELD", 50)
    path = vocabulary("byte_bpe_50k.json")
    long = "".join(R.choice("abcdefgh") for _ in range(300_000))
    rows = token_counts.token_counts(spark.createDataFrame([(1, long, None), (2, long + " " + prose(300), [(0, 1, None), (5, None, "x")])], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("edits", token_counts.EDITS)])), path).collect()
    want = tiktoken_length(long)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == want and rows[1].n_tokens_after > 0
    own = bpe.TrieBpe(vocabulary("word_bpe_49k.json"))
    got = np.frombuffer(own.encode_batch([long])[0], np.int32).tolist()
    from tokenizers import Tokenizer

    assert got == Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids[: len(got)] and not [p for p in own.cache if len(p) > 64]


def tiktoken_length(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)


def test_quality(spark, corpus, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_table(corpus, labels).join(labels, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in got) / len(got) > 0.95
    odd = quality.quality(docs, labels.limit(0))
    assert odd.count() == docs.count() and set(odd.columns) == set(docs.columns) | set(quality.RESULTS)
    assert quality.quality_table(docs.limit(0), labels).count() == 0 == quality.quality(docs.limit(0), labels).count()
    assert {r.toxicity for r in quality.quality_table(corpus, labels.drop("toxic")).collect()} == {0.0}


def test_quality_keeps_any_column(spark, corpus, monkeypatch):
    """Columns with the names of results are replaced, all others stay; rates that are too large to broadcast give the same."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = corpus.select("*", *(F.lit("own").alias(c) for c in ("path_rate", "host", "path", "doc", "s", "salt", "posterior", "_host", "_id", "_y")))
    got = quality.quality(odd, labels)
    assert set(got.columns) == set(odd.columns) | set(quality.RESULTS) and got.where("host = 'own' and salt = 'own' and path_rate < 1").count() == corpus.count()
    want = {r.doc_id: (r.posterior, r.text) for r in got.collect()}
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert {r.doc_id: (r.posterior, r.text) for r in quality.quality(odd, labels).collect()} == want


def test_quality_held_out(spark):
    """Accuracy on labelled documents that the models haven't seen, for both labels."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    unseen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    rows = quality.quality_table(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where(~unseen)).join(labels.where(unseen), "doc_id").collect()
    good = sum(r.keep == bool(r.quality) for r in rows) / len(rows)
    toxic = [r.toxicity >= 0.5 for r in rows if r.toxic]
    clean = [r.toxicity < 0.5 for r in rows if not r.toxic]
    print("held out", len(rows), good, sum(toxic) / len(toxic), sum(clean) / len(clean))
    assert len(rows) > 500 and good > 0.97 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) > 0.98


def test_quality_posterior_by_hand(spark, corpus):
    """Rates, strengths and posteriors recomputed from the evidence, by the formulas, in plain Python."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    varied = corpus.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/a"))).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")))
    model, share = quality.train(varied, labels)
    text = {r.doc_id: r for r in varied.collect()}
    groups, evidence = defaultdict(list), {}
    for i, r in text.items():
        evidence[i] = model.evidence(r.text)
        host = (r.source or "").split("/")[0]
        groups[host, r.source if r.source and "/" in r.source else r.lang or ""].append(i)
    p = {i: 1 / (1 + np.exp(-(e + np.log(share / (1 - share))))) for i, e in evidence.items()}
    hosts = defaultdict(list)
    for (host, _), ids in groups.items():
        hosts[host] += [p[i] for i in ids]
    g = np.mean([x for v in hosts.values() for x in v])

    def strength(ns, ps, means):
        ns, ps, means = map(np.array, (ns, ps, means))
        return min(max(means.mean() * (1 - means.mean()) / max((ns * (ps - means) ** 2).sum() / ns.sum(), 1e-9) - 1, 1.0), 1e4)

    kh = strength([len(v) for v in hosts.values()], [np.mean(v) for v in hosts.values()], [g] * len(hosts))
    host_rate = {h: (sum(v) + kh * g) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength([len(v) for v in groups.values()], [np.mean([p[i] for i in v]) for v in groups.values()], [host_rate[h] for h, _ in groups])
    got = by_id(quality.quality_table(varied, labels))
    for (host, path), ids in groups.items():
        rate = (sum(p[i] for i in ids) + kp * host_rate[host]) / (len(ids) + kp)
        clipped = min(max(rate, 1e-4), 1 - 1e-4)
        for i in ids:
            r = got[i]
            assert (r.host, r.path) == (host, path) and np.allclose((r.host_rate, r.path_rate, r.posterior), (host_rate[host], rate, 1 / (1 + np.exp(-(evidence[i] + np.log(clipped / (1 - clipped)))))), rtol=1e-9)
            assert r.keep == (r.posterior >= 0.5)


def test_quality_shrinks_sparse_paths(spark):
    good, bad = "The plain words of a calm text, in lines. ", "BAD!! NOISE!! "
    rows = [(i, (bad if i % 2 else good) * 20, "en", "big/a" if i < 60 else "tiny/b", 1) for i in range(61)]
    got = by_id(quality.quality_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")))
    assert got[60].path_rate < 0.999 and got[0].host == "big" and got[0].path == "big/a" and got[0].keep and not got[1].keep


def test_exact_dedup(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 100)
    rows = exact_dedup.exact_dedup(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    want = sorted((str(i), str(min(x for x in ids if x is not None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_patricia():
    trie, keys = exact_dedup.Patricia(), [bytes(R.choices(b"ab", k=R.randint(0, 9))) for _ in range(400)]
    for i, k in enumerate(keys):
        trie.add(k, i, 1, None)
    assert {k: (v[0], v[1]) for k, v in trie.items()} == {k: (keys.index(k), keys.count(k)) for k in keys}


def test_patricia_spills_subtrees():
    """What is cut off and what stays make up all keys, with counts that add up; the goal is met and little more is cut."""
    for trial in range(30):
        trie, seen = exact_dedup.Patricia(), defaultdict(int)
        out, low = defaultdict(int), {}
        for i in range(400):
            k = bytes(R.choices(b"abc", k=R.randint(0, 12)))
            trie.add(k, i, 1, None)
            seen[k] += 1
            if i % 97 == 96:
                before, goal = trie.bytes, R.randint(1, trie.bytes)
                for key, (least, n, _) in trie.cut_off(goal):
                    out[key] += n
                    low[key] = min(low.get(key, least), least)
                assert before - trie.bytes >= min(goal, before) - 400
        for key, (least, n, _) in trie.items():
            out[key] += n
            low[key] = min(low.get(key, least), least)
        assert out == seen
    assert list(exact_dedup.Patricia().cut_off(10)) == []


def test_word_hashes(monkeypatch):
    """As many distinct hashes as words, equal ones for equal words, in order, whatever the pieces."""
    seen = {}
    for trial in range(150):
        monkeypatch.setattr(common, "_PIECE", R.choice((8, 16, 64, 1 << 18)) if trial else 1 << 18)
        texts = TEXTS if not trial else ["".join(R.choice("ab \n\tÉéAB\x0b\x1c") for _ in range(R.randint(0, 60))) + R.choice(("", "x" * 40)) for _ in range(R.randint(0, 6))] + [None]
        hashes, ends = common.word_hashes(texts)
        words = [w for t in texts for w in [*common.words_of(t), None]]
        assert len(words) == len(hashes) and len(ends) == len(texts) and all(words[k - 1] is None for k in ends)
        own = seen if common._PIECE == 1 << 18 else {}
        assert all(own.setdefault(w, h) == h for w, h in zip(words, hashes.tolist())) and len(set(own.values())) == len(own)
    assert len(common.word_hashes([])[0]) == 0


def brute_near(rows, width, percent):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width,percent,block", [(3, 85, 512), (5, 80, 4)])
def test_near_dedup(spark, docs, monkeypatch, width, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SHARE", 3)
    family, rows = BASE.split(), [r.asDict() for r in docs.collect()]
    for i in range(60):  # a chain of copies that drift apart
        family = [R.choice(WORDS) if R.random() < 0.02 else w for w in family]
        rows.append({"doc_id": 1_000 - i, "text": " ".join(family)})
    held = spark.createDataFrame([(r["doc_id"], r["text"], 0) for r in rows], "doc_id long, text string, key int")
    got = near_dedup.near_dedup(held, width, percent).collect()
    want = brute_near(held.collect(), width, percent)
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_near_dedup_ids_of_several_texts(spark):
    other = prose(80)
    rows = [(3, BASE), (5, BASE), (5, other), (7, other), (7, NEAR), (8, prose(80)), (8, "x y z"), (9, "x y z"), (None, BASE)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (None, None)}


@pytest.mark.parametrize("similarity,most", [(0.85, 1e-5), (0.80, 1e-4)])
def test_near_dedup_recall(similarity, most):
    """Pairs of a given similarity meet in a table as often as stated."""
    assert 1 - near_dedup.meets(similarity) < most and near_dedup.meets(0.05) < 1e-5
    rng, met, trials, n = np.random.default_rng(3), 0, 300, 1_000
    for _ in range(trials):
        both = round(2 * n * similarity / (1 + similarity))
        s = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        x, y = (near_dedup.bands(near_dedup.minhashes(p), near_dedup.SIDE) for p in (s[:n], s[n - both :]))
        met += bool((x[0] == y[0]).any() and (x[1] == y[1]).any())
    assert met == trials
    far = near_dedup.meets(0.3)
    met = 0
    for _ in range(trials):
        both = round(2 * n * 0.3 / 1.3)
        s = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        x, y = (near_dedup.bands(near_dedup.minhashes(p), near_dedup.SIDE) for p in (s[:n], s[n - both :]))
        met += bool((x[0] == y[0]).any() and (x[1] == y[1]).any())
    assert abs(met / trials - far) < 0.07


def test_near_dedup_empty(docs):
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    passage = " ".join(WORDS[:40])
    items = spark.createDataFrame([(1, passage), (2, None), (3, "!!"), (4, "one two"), (4, "one two"), (None, passage), (5, " ".join(WORDS[100:140]))], "item_id long, text string")
    held = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100, LONG + " " + passage.upper().replace(" ", ", ") + " " + prose(50)), (101, " ".join(WORDS[:36])), (102, " ".join(WORDS[:30])), (103, passage.replace("w20 ", "other "))], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): round(r.containment, 3) for r in decontaminate.contaminated(held, items).collect()}
    assert {k: v for k, v in got.items() if k[1] != 4} == {(100, 1): 1.0, (101, 1): round(32 / 36, 3), (103, 1): round(31 / 36, 3)}
    assert {k[0] for k in got if k[1] == 4} == {9, 10}
    clashing = held.select("*", *(F.lit(1).alias(c) for c in ("w", "width", "hash", "shingle", "item_id", "k")))
    assert {(r.doc_id, r.item_id): round(r.containment, 3) for r in decontaminate.contaminated(clashing, items.withColumn("doc_id", F.lit(3))).collect()} == got
    assert decontaminate.contaminated(held, items.limit(0)).count() == 0 == decontaminate.contaminated(held.limit(0), items).count()


def test_decontamination_sql_of_short_items(spark):
    """The operator and its SQL agree on items of one to seven words, with and without broadcasts."""
    import duckdb

    small = [f"w{i}" for i in range(9)]
    docs = [(i, " ".join(R.choice(small) for _ in range(R.randint(0, 40)))) for i in range(80)] + [(90, None)]
    items = [(i, " ".join(R.choice(small) for _ in range(R.randint(1, 7)))) for i in range(25)] + [(40, ""), (41, None)]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.register(name, pa.table({key: [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    want = sorted(con.execute(decontaminate.ORACLE).fetchall())
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  Subscribe now \nSubscribe now\n\nlast {i}", f"s{i % 9}") for i in range(30)] + [(90, "few\nSubscribe now", None), (91, "few", "s1"), (92, None, "s2"), (None, "Subscribe now", "s3")]
    held = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites, gone in ((8, True), (9, True), (10, False)):
        got = by_id(line_dedup.line_dedup(held, sites))
        assert got[3].n_removed == (2 if gone else 0) and got[3].n_lines == 5 and got[92].clean_text == "" and got[90].clean_text == ("few" if gone else "few\nSubscribe now")
        assert got[None].n_removed == int(gone)
    assert line_dedup.line_dedup(held.limit(0)).count() == 0


def test_line_dedup_both_ways(spark, monkeypatch):
    """Boilerplate sought in place and by a join, with clashing columns and long texts, against plain Python."""
    marks = [f"Footer {k}" for k in range(12)]
    rows = [(R.choice((i, i, None)), "\n".join(R.choice((f"own {i} {k}", f" {R.choice(marks)}\t", "")) for k in range(R.choice((0, 3, 9, 400)))), R.choice((None, *(f"s{k}" for k in range(12)))), "x", "y", "z") for i in range(120)] + [(7, None, "s1", "x", "y", "z")]
    held = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string, clean_text string, k string")
    sites = defaultdict(set)
    strip = lambda line: line.strip(" \t\r\x0b\x0c")
    for _, t, source, *_ in rows:
        for line in (t or "").split("\n"):
            if source and strip(line):
                sites[strip(line)].add(source)
    bad = {line for line, s in sites.items() if len(s) >= 8}
    want = sorted((str(i), "\n".join(line for line in (t or "").split("\n") if strip(line) not in bad), len((t or "").split("\n")), "z") for i, t, *_ in rows)
    for literal in (4_000, 0):
        monkeypatch.setattr(line_dedup, "LITERAL_LINES", literal)
        got = line_dedup.line_dedup(held)
        assert sorted((str(r.doc_id), r.clean_text, r.n_lines, r.k) for r in got.collect()) == want and bad


def test_licenses(docs):
    got = by_id(licenses.license_table(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in docs.where("doc_id is not null").collect():
        w = word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or ""))
        at = sorted((i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert g.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
    assert got[17].base_labels == "apache,gpl,mit" and got[17].n_base == 3 and 0 <= got[17].score <= 1


RULES = [("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"), ("under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Licensed under CC BY 4.0.", "cc-by-4.0"), ("licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("the new BSD license", "bsd-3-clause"), ("see https://opensource.org/licenses/MIT now", "mit"), ("permits licensing", ""), ("All rights reserved", "all-rights-reserved")]


def test_license_rules(spark):
    got = by_id(licenses.license_table(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RULES)], "doc_id long, text string")))
    assert [got[i].labels for i in range(len(RULES))] == [x for _, x in RULES]


def samples(pattern, n):
    """Texts that a rule's pattern matches whole, at random."""
    from re import _parser

    def one(tree):
        out = ""
        for op, arg in tree:
            match str(op):
                case "LITERAL":
                    out += chr(arg)
                case "NOT_LITERAL":
                    out += "~"
                case "ANY":
                    out += "x"
                case "IN":
                    kind, value = R.choice(arg) if str(arg[0][0]) != "NEGATE" else ("LITERAL", ord("~"))
                    out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(R.randint(*value)), "CATEGORY": lambda: R.choice({"CATEGORY_SPACE": " \n\t", "CATEGORY_DIGIT": "0123456789", "CATEGORY_WORD": "abc"}.get(str(value), "x"))}[str(kind)]()
                case "MAX_REPEAT" | "MIN_REPEAT":
                    out += "".join(one(arg[2]) for _ in range(R.randint(arg[0], min(arg[1], arg[0] + 2))))
                case "SUBPATTERN":
                    out += one(arg[3])
                case "BRANCH":
                    out += one(R.choice(arg[1]))
                case "AT" | "ASSERT_NOT":
                    pass
                case _:
                    raise ValueError(op)
        return out

    tree, flags = _parser.parse(pattern), re.ASCII
    texts = [one(tree) for _ in range(n)]
    return [x for x in texts if re.compile(pattern, flags).fullmatch(x)]


def test_license_keywords_lose_nothing():
    gates = licenses.gates()
    for key, label, pattern, _, _ in licenses.rules():
        got = samples(pattern, 60)
        assert len(got) > 10, pattern
        for x in got:
            assert licenses.plain(key) in licenses.plain(x) and any(g in licenses.plain(x) for g in gates), (label, x)


KEYED = [("under the Universal Permissive License", "upl-1.0"), ("under the Open RAIL-M License", "openrail"), ("Public Domain Dedication and License", "pddl-1.0"), ("the Beer-Ware License", "beerware"), ("Creative\nCommons Attribution 4.0", "cc-by,cc-by-4.0"), ("All rights\nreserved", "all-rights-reserved"), ("is in the public  domain", "public-domain"), ("CC  BY-SA 4.0", "cc-by-sa,cc-by-sa-4.0"), ("GNU General\nPublic License", "gpl"), ("the Python\n  Software Foundation License", "psf-2.0"), ("may not be copied", "proprietary"), ("dual-licenced", "dual-licensed"), ("Apache 2.0", "apache-2.0")]


def test_license_keys_of_wrapped_texts(spark):
    got = by_id(licenses.license_table(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KEYED)], "doc_id long, text string")))
    for i, (t, labels) in enumerate(KEYED):
        assert set(labels.split(",")) & set(got[i].labels.split(",")), (t, got[i].labels)


MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation files (the "Software"), to deal"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from"""
BSD4 = """3. All advertising materials mentioning features or use of this
   software must display the following acknowledgement:"""
HOLDER = "The Regents of the Very Long Named University of Somewhere,\n   its Departments, Laboratories and all Affiliated Institutes and Centres of Study"
NOTICED = [(MIT, "mit"), (ISC, "isc"), (BSD, "bsd,bsd-3-clause"), (BSD4, "bsd-4-clause"), (BSD.replace("the copyright holder", HOLDER), "bsd,bsd-3-clause"), (BSD.replace("the copyright holder", HOLDER * 20), "bsd,bsd-3-clause")]


def test_license_notices_wrapped(spark):
    marked = [("".join(f"{mark}{line}\n" for line in t.split("\n")), labels) for t, labels in NOTICED for mark in ("", " * ", "# ", "// ", ";; ", "% ", "-- ")]
    marked += [(" ".join(t.split()), labels) for t, labels in NOTICED] + [(t.replace("\n", "\r\n"), labels) for t, labels in NOTICED]
    got = by_id(licenses.license_table(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(marked)], "doc_id long, text string")))
    assert [got[i].labels for i in range(len(marked))] == [x for _, x in marked]


def test_license_suppression(spark):
    """Random intervals against the rule of the module, each with each."""
    rows = [(row, k, s, s + R.randint(1, 12), R.choice((50, 55, 60, 90)), R.randint(0, 5)) for row in range(60) for k in range(R.randint(1, 25)) for s in [R.randint(0, 30)]]
    rows = list({(r[0], r[2], r[3], r[4], r[5]): r for r in rows}.values())
    ranks = {}
    rows = [(row, k, s, e, ranks.setdefault(nr, rank), nr) for row, k, s, e, rank, nr in rows]  # a rule has one priority
    rows = list({(r[0], r[2], r[3], r[5]): r for r in rows}.values())

    def beats(o, x):
        same = (o[2], o[3]) == (x[2], x[3])
        return o is not x and o[2] <= x[2] and o[3] >= x[3] and (o[4] > x[4] or o[4] == x[4] and (not same or o[5] < x[5]))

    got = licenses.suppressed(spark.createDataFrame(rows, "_row long, k int, s long, e long, rank int, nr int"), list(ranks.values())).collect()
    want = {(x[0], x[1], x[2], x[3], x[5]): any(beats(o, x) for o in rows if o[0] == x[0]) for x in rows}
    assert {(r._row, r.k, r.s, r.e, r.nr): r.beaten for r in got} == want and {True, False} == set(want.values())


def test_license_labels_against_python(spark):
    """Labels, scores and places of every rule's matches by Python's own engine."""
    names = ["MIT License", "GNU Lesser General Public License v2.1", "the Apache License, Version 2.0", "BSD 3-Clause license", "CC BY-SA 4.0", "Creative Commons Attribution", "SPDX-License-Identifier: MIT", "all rights reserved", "gpl licensed", "word", "licensed under the", "released under", "zlib", "\n"]
    texts = ["", None, *(" ".join(R.choice(names) for _ in range(R.randint(1, 14))) for _ in range(60))]
    got = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    table = licenses.rules()
    for i, text in enumerate(texts):
        low = (text or "").lower()
        spans = [(m.start(), m.end(), label, rank, sure, nr) for nr, (key, label, p, rank, sure) in enumerate(table) if licenses.plain(key) in licenses.plain(low) for m in re.finditer(p, low, re.ASCII)]
        beats = lambda o, x: o[0] <= x[0] and o[1] >= x[1] and (o[3] > x[3] or o[3] == x[3] and (o[:2] != x[:2] or o[5] < x[5]))
        left = sorted(x for x in spans if not any(beats(o, x) for o in spans if o is not x))
        assert [tuple(d) for d in got[i].detections] == left, text
        assert set(got[i].labels.split(",")) - {""} == {x[2] for x in left} | (set(got[i].base_labels.split(",")) - {""})
        assert got[i].score == max([0.6 if got[i].n_base else 0.0, *(x[4] for x in left)])


def test_license_many_matches_in_one_text(spark):
    """Time grows as the matches, not as their square."""
    import time

    n = 64_000
    began = time.time()
    got = by_id(licenses.license_scan(spark.createDataFrame([(1, "see the mit license and gpl license. " * (n // 2)), (2, "mit license"), (None, "gpl"), (2, "mit license")], "doc_id long, text string")).select("doc_id", "n_base", "labels", F.size("detections").alias("n")))
    assert (got[1].n, got[1].n_base, got[1].labels) == (n, n // 2, "gpl,mit") and got[None].labels == ""
    assert time.time() - began < 60


def test_hundreds_of_rules():
    assert len(licenses.rules()) > 200 and all(re.compile(r[2]) for r in licenses.rules())


def test_language(spark, corpus, docs):
    got = language_id.language_table(corpus).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9
    odd = language_id.language_table(docs.withColumn("text", F.when(F.col("doc_id") == 9, "12 !?").otherwise(F.col("text")))).collect()
    assert len(odd) == docs.count() and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (4, 6, 7, 9)) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in language_id.language_table(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_table(docs.limit(0)).count() == 0


def test_language_bits_and_decoding_by_hand(spark):
    """Log-odds, borders, trusts and decoding recomputed in plain Python from the training documents."""
    import math

    letters = {"aa": "abcde", "bb": "cdefg", "cc": "xyzé", "dd": "qrstu"}
    rows = [(i, lang, "".join(R.choice(letters[lang] + " o") for _ in range(R.randint(3, 60)))) for i in range(160) for lang in [R.choice(sorted(letters))]] + [(900, "aa", None), (901, "bb", "12 3"), (902, None, "abc")]
    held = spark.createDataFrame([(i, lang, t, 1) for i, lang, t in rows], "doc_id long, lang string, text string, part int")
    model = language_id.fit(held)
    assert model.languages == sorted(letters)
    shares = {x: np.zeros(language_id.DIMENSIONS) for x in letters}
    n, at = defaultdict(int), {}
    for i, lang, t in rows:
        b = language_id.buckets(t) if lang else None
        if b is not None:
            at[i] = b
            n[lang] += 1
            for x in b:
                shares[lang][x] += 1 / len(b)
    floor = language_id.SMOOTH / language_id.DIMENSIONS
    for k in range(model.code.shape[1]):
        mean = lambda sign: sum(shares[x] / n[x] for x, c in zip(model.languages, model.code[:, k]) if c == sign) / (model.code[:, k] == sign).sum()
        assert np.allclose(model.weights[:, k], np.log((mean(1) + floor) / (mean(-1) + floor)), atol=1e-4)
        kinds = {s: [float(np.mean([model.weights[x, k] for x in at[i]], dtype=np.float64)) for i, lang, _ in rows if i in at and model.code[model.languages.index(lang), k] == s] for s in (1, -1)}
        (m1, s1), (m0, s0) = ((np.mean(kinds[s]), np.std(kinds[s])) for s in (1, -1))
        wrong = 0.5 * math.erfc((m1 - m0) / (s1 + s0) / math.sqrt(2))
        assert np.allclose((model.border[k], model.scale[k], model.trust[k]), ((m1 * s0 + m0 * s1) / (s0 + s1), (m1 - m0) / 2, 0.5 * math.log((1 - wrong + 1e-3) / (wrong + 1e-3))), rtol=1e-3)
    got = by_id(language_id.predict(held, model))
    for i, _, t in rows:
        b = language_id.buckets(t)
        if b is None:
            assert got[i].lang_pred == "und"
            continue
        z = [(sum(float(model.weights[x, k]) for x in b) / len(b) - model.border[k]) / model.scale[k] for k in range(model.code.shape[1])]
        loss = [sum(model.trust[k] * math.exp(min(30, max(-30, -row[k] * z[k]))) for k in range(len(z))) / sum(model.trust) for row in model.code]
        assert got[i].lang_pred == model.languages[int(np.argmin(loss))] and got[i].ambiguous == (sorted(loss)[1] - min(loss) < language_id.AMBIGUOUS)
        near = [math.exp(-4 * (x - min(loss))) for x in loss]
        assert abs(got[i].score - max(near) / sum(near)) < 1e-6


def test_language_ties_clashes_and_many_languages(spark):
    same = [(i, x, "ab ab", "k") for i, x in enumerate("ba" * 6)]
    got = language_id.predict(spark.createDataFrame(same, "doc_id long, lang string, text string, lang_pred string"), language_id.fit(spark.createDataFrame(same, "doc_id long, lang string, text string, sums string"))).collect()
    assert {r.lang_pred for r in got} == {"a"} and all(r.ambiguous for r in got)
    many = [(i, f"l{i % 30:02}", "".join(R.choice("abcdefghijklmnopqrstuvwxyz"[i % 20 : i % 20 + 4] + chr(1072 + i % 30)) for _ in range(80))) for i in range(240)]
    held = spark.createDataFrame(many, "doc_id long, lang string, text string")
    model = language_id.fit(held)
    right = sum(r.lang_pred == f"l{r.doc_id % 30:02}" for r in language_id.predict(held, model).collect())
    assert len(model.languages) == 30 and right / len(many) > 0.9


def test_codewords():
    for n in (2, 4, 7, 9, 40):
        code = language_id.codewords(n)
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (1 if n == 2 else 2)


def brute_lm(rows, train):
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in rows}
    c1, c2 = defaultdict(int), defaultdict(int)
    for i in train:
        for v, w in zip([None, *tokens[i][:-1]], tokens[i]):
            c1[w] += 1
            c2[v, w] += 1
    n, kinds = sum(c1.values()), len(c1)
    before, after = defaultdict(int), defaultdict(lambda: [0, 0, 0, 0])
    for (v, w), c in c2.items():
        before[w] += 1
        after[v][0] += c
        after[v][min(c, 3)] += 1
    of = lambda counts: [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
    low, high = ngram_lm.discounts(of(before.values())), ngram_lm.discounts(of(c2.values()))
    less = lambda c, d: ([0.0] + d)[min(c, 3)]
    gamma0 = sum(less(x, low) for x in before.values()) / len(c2)
    out = {}
    for i, ts in tokens.items():
        score = 0.0
        for v, w in zip([None, *ts[:-1]], ts):
            p = max(before[w] - less(before[w], low), 0) / len(c2) + gamma0 / (kinds + 1)
            a = after.get(v)
            if a:
                c = c2.get((v, w), 0)
                p = max(c - less(c, high), 0) / a[0] + sum(k * d for k, d in zip(a[1:], high)) / a[0] * p
            score += np.log10(p)
        out[i] = (len(ts), sum(w in c1 for w in ts), n, sum(np.log10((c1.get(w, 0) + 1) / (n + kinds + 1)) for w in ts), score)
    return out


def test_lm(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "RANGE", 500)
    monkeypatch.setattr(ngram_lm, "ROOT", 1)
    rows = [(i, prose(R.randint(0, 80)) + (" Common words" * (i % 5))) for i in range(60)] + [(100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(ngram_lm.lm_table(df))
    want = brute_lm(rows, [i for i in got if not got[i].held_out])
    assert any(r.held_out for r in got.values())
    for i, w in want.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3] and np.allclose((g.base_score, g.score), w[3:], rtol=1e-9), i
    assert len(ngram_lm.lm_table(docs).collect()) == docs.count() and ngram_lm.lm_table(docs.limit(0)).count() == 0


def brute_order(rows, train, order):
    """Scores by the definition, over strings."""
    tokens = {i: [None, *t.encode().lower().split(), b"\n"] for i, t in rows}
    counts = [defaultdict(int) for _ in range(order + 1)]
    for i in train:
        for n in range(1, order + 1):
            for j in range(n - 1, len(tokens[i])):
                counts[n][tuple(tokens[i][j - n + 1 : j + 1])] += 1
    own = {order: counts[order]}
    for n in range(1, order):
        own[n] = defaultdict(int, {g: c for g, c in counts[n].items() if g[0] is None and n > 1})
        for g in counts[n + 1]:
            own[n][g[1:]] += 1
    d = {n: [0.0] + ngram_lm.discounts([sum(x == k for x in own[n].values()) for k in (1, 2, 3, 4)]) for n in own}
    after = {n: defaultdict(list) for n in own}
    for n in own:
        for g, c in own[n].items():
            after[n][g[:-1]].append(c)

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(own[1]) + 1)
        a, c = after[len(g)].get(g[:-1]), own[len(g)].get(g, 0)
        return (c - d[len(g)][min(c, 3)] + sum(d[len(g)][min(x, 3)] for x in a) * lower) / sum(a) if a else lower

    return {i: sum(np.log10(p(tuple(ts[max(0, j - order + 1) : j + 1]))) for j in range(1, len(ts))) for i, ts in tokens.items()}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_orders(spark, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "RANGE", 700)
    monkeypatch.setattr(ngram_lm, "ROOT", 1)
    monkeypatch.setattr(ngram_lm, "FEW", 3)
    some = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join(R.choice(some) for _ in range(R.randint(0, 90))) + " the same words again" * (i % 4)) for i in range(60)] + [(100, "")]
    got = by_id(ngram_lm.lm_table(spark.createDataFrame(rows, "doc_id long, text string"), order))
    want = brute_order(rows, [i for i in got if not got[i].held_out], order)
    assert all(np.isclose(got[i].score, want[i], rtol=1e-9) for i in want)


def test_lm_open_files_are_bounded(spark, monkeypatch):
    """With many ranges a worker still maps few files at a time, and scores stay the same."""
    monkeypatch.setattr(ngram_lm, "ROOT", 1)
    rows = [(i, " ".join(R.choice(WORDS) for _ in range(80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: r.score for i, r in by_id(ngram_lm.lm_table(df, 3)).items()}
    monkeypatch.setattr(ngram_lm, "RANGE", 30)
    model = ngram_lm.train(df.where(~language_id.held_out(7, 2)), 3)
    assert model.ranges > 50
    monkeypatch.setattr(ngram_lm, "MAPPED", 4)
    levels = ngram_lm._levels(model.folder, 3, model.ranges, [model.kinds + 1, *model.sizes[1:]], model.kinds.bit_length())
    words = ngram_lm._Vocabulary(model.folder)
    number, _, ends = ngram_lm._tokens([t for _, t in rows], words)
    ctx = ngram_lm._before(number, ends, model.kinds)
    for level in levels:
        ids, c = level.find(ctx, number, counts=True)
        level.sums(np.unique(ctx[ctx >= 0]))
        ctx = ngram_lm._before(ids, ends, -1)
        assert len(level.held) <= 4 and (c > 0).any()
    got = by_id(ngram_lm.score(df, model))
    assert all(np.isclose(got[i].score, s, rtol=1e-12) for i, s in want.items())


def test_packed_runs():
    keys = np.sort(np.array(sorted({R.getrandbits(62) for _ in range(500)}), np.uint64) * np.uint64(2))
    counts = np.array([R.randint(1, 300) for _ in keys])
    k, c = ngram_lm.unpack(ngram_lm.pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()


@pytest.fixture
def small_skew(spark):
    """Joins are shuffled, and a partition of some kilobytes that is twice as large as the others counts as skewed."""
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_text_that_fills_a_third(spark, small_skew):
    """The join of ids to the owner of a text that a third of all rows have is split, and its group is whole."""
    n = 30_000
    held = spark.range(n).select(F.xxhash64("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(BASE)).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text")).repartition(8)
    hot = {r.doc_id for r in held.where("text not like 'own %'").select("doc_id").collect()}
    first, got = min(hot), exact_dedup.exact_dedup(held)
    rows = got.collect()
    assert len(rows) == n and len(hot) == n // 3 and all((r.keep_id, r.group_size) == ((first, len(hot)) if r.doc_id in hot else (r.doc_id, 1)) for r in rows)
    assert {r.doc_id for r in rows if r.group_size > 1} == hot
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()


def test_near_copies_that_fill_a_third(spark, small_skew):
    """A family of near copies as large as a third of the rows becomes one component without its pairs being formed."""
    words, rows = BASE.split(), []
    for i in range(1_500):
        if i % 3 == 0:
            k = R.randrange(len(words))
            rows.append((i, " ".join([*words[:k], f"new{i}", *words[k + 1 :]])))
        else:
            rows.append((i, " ".join(f"x{i}y{j}" for j in range(12))))
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i].component_id == (0 if i % 3 == 0 else i) for i, _ in rows)


def test_a_path_that_holds_a_third(spark, small_skew, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    rows = [(i, "The plain words of a calm text. " * 3, "en", "hot/path" if i % 3 == 0 else f"h{i}/p") for i in range(6_000)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert got.select("doc_id").distinct().count() == 6_000 == got.count()


CLASHING = "_row _id _sha _text _len _low _plain _rows _w x y key low high n one ones rep part role component keys_a sketch h g c r run at v sums docs lang_pred held_out score n_tokens n_shingles component_id kept keep_id group_size labels base m nr k s e rank left found host path evidence w width hash shingle line ids decoded words last starts".split()
OPERATORS = {
    "bpe": lambda d, f: bpe.bpe_digests(d, vocabulary("word_bpe_49k.json")),
    "counts": lambda d, f: token_counts.token_counts(d.withColumn("edits", token_counts.stated_edits()), vocabulary("byte_bpe_50k.json")),
    "quality": lambda d, f: quality.quality_table(d, f("labels")),
    "exact": lambda d, f: exact_dedup.exact_dedup(d),
    "lm": lambda d, f: ngram_lm.lm_table(d, 3).drop("perplexity"),
    "decontamination": lambda d, f: decontaminate.contaminated(d, f("benchmark")),
    "near": lambda d, f: near_dedup.near_dedup(d),
    "lines": lambda d, f: line_dedup.line_dedup(d).select("doc_id", "n_lines", "n_removed", "clean_text"),
    "licenses": lambda d, f: licenses.license_table(d),
    "language": lambda d, f: language_id.language_table(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_other_names_change_nothing(spark, corpus, docs, name):
    """Each operator over nulls, repeated rows and very long texts, with and without columns that bear names of its own."""
    own = docs.select("doc_id", "text", "lang", "source").unionByName(corpus.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source").limit(60))
    file = lambda x: spark.read.parquet(f"{SF}/{x}.parquet")
    shown = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    plain, clashing = (shown(OPERATORS[name](d, file)) for d in (own, own.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))))
    assert plain == clashing and (len(plain) == own.count() or name == "decontamination")


def test_pipeline(spark):
    import corpus_pipeline

    docs, left, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}, None
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held
        held = stage(spark, held, SF).persist()
        assert held.columns == corpus_pipeline.COLUMNS, name
        left[name] = ({r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in held.select("doc_id").collect()})
    rows = docs.collect()
    text = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows}
    came, went = left["exact_dedup"]
    first = {}
    for i in sorted(came):
        first.setdefault(text[i], i)
    assert went == set(first.values())
    came, went = left["near_dedup"]
    want = brute_near([r for r in rows if r.doc_id in came], 5, 80)
    assert went == {i for i, (_, c) in want.items() if i == c}
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == left["decontamination"][1] and left["decontamination"][1] < left["decontamination"][0]
    kept = corpus_pipeline.exact_stage(spark, docs.limit(0), SF)
    assert kept.count() == 0


def test_pipeline_decides_by_row(spark):
    """Repeated ids with other texts, rows without an id and repeated rows lose nothing but copies."""
    import corpus_pipeline as cp

    other, third, far = prose(90), prose(90), prose(70)
    near = other.replace(other.split()[40], "else")
    rows = [(1, "a b c"), (5, "a b c"), (5, "quite another text"), (5, other), (None, "a  b c"), (None, third), (None, third), (None, None), (7, near), (8, far), (8, far), (9, None), (2**63 - 1, "alone at the last id")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = sorted([(1, "a b c"), (5, "quite another text"), (5, other), (None, third), (None, third), (7, near), (8, far), (8, far), (9, None), (2**63 - 1, "alone at the last id")], key=str)
    exact = cp.exact_stage(spark, docs, SF)
    assert exact.columns == cp.COLUMNS and pairs(exact) == want
    stayed = cp.near_stage(spark, exact, SF)
    gone = sorted([(1, "a b c"), (5, "quite another text"), (5, other), (None, third), (8, far), (9, None), (2**63 - 1, "alone at the last id")], key=str)
    assert stayed.columns == cp.COLUMNS and pairs(stayed) == gone
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    held = spark.createDataFrame([(5, f"{third} {item}", "en", "s", 1), (5, third, "en", "s", 1), (None, item, "en", "s", 1), (None, other, "en", "s", 1)], docs.schema)
    assert pairs(cp.decontamination_stage(spark, held, SF)) == sorted([(5, third), (None, other)], key=str)
    plain = cp.decontamination_stage(spark, held.where("doc_id is not null").withColumn("doc_id", F.length("text").cast("long")), SF)
    assert [r.text for r in plain.collect()] == [third]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
