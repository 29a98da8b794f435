import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, common, components, elias_fano, exact_dedup, html_extract, language_id, lm_score, mixing, ngram_join, pieces, sentencepieces, substring_dedup, token_counts

DOC = "doc_id long, text string, lang string, source string"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, None, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(texts)], DOC)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- exact dedup ---


@pytest.mark.parametrize("moduli,huge", [(exact_dedup.MODULI, 1 << 23), ((7, 5), 1 << 23), (exact_dedup.MODULI, 40)])
def test_exact_dedup_survives_collisions_and_huge_texts(spark, moduli, huge):
    r = random.Random(1)
    texts = [words(r, 12, 3)[:60] for _ in range(40)] * 2 + [None, "", "", "é" * 100, "é" * 100]
    got = exact_dedup.groups(docs(spark, texts), moduli=moduli, chunk_bytes=16, huge_bytes=huge).toPandas()
    by = {}
    for i, t in enumerate(texts, 1):
        by.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    for x in got.itertuples():
        g = by[texts[x.doc_id - 1] or ""]
        assert (x.keep_id, x.group_size, x.kept) == (max(g), len(g), x.doc_id == max(g))


def test_fingerprints_compose():
    f = exact_dedup.Fingerprint(chunk=8)
    data = np.frombuffer(b"the quick brown fox jumps", np.uint8)
    parts = [f.of_chunk(data[i : i + 5], len(data) - min(len(data), i + 5)) for i in range(0, len(data), 5)]
    assert tuple(sum(p[k] for p in parts) % f.moduli[k] for k in (0, 1)) == f.of(data)


def test_dedup_keeps_one_of_identical_rows(spark):
    df = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (2, "a", 8), (None, "b", 9), (3, None, 1), (2, "a", 8)], "doc_id long, text string, _len long")
    assert sorted((x.doc_id, x.text) for x in exact_dedup.dedup(df).collect() if x.doc_id) == [(2, "a"), (3, None)]
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_exact_dedup_hands_small_batches_without_texts_to_python(spark, monkeypatch):
    """What held an executor's memory: 10,000 whole texts a batch, sent to Python and back."""
    rows, real, before = [], exact_dedup.stored, spark.conf.get(common.BATCHES)
    monkeypatch.setattr(exact_dedup, "stored", lambda df, name: rows.append((name, int(spark.conf.get(common.BATCHES)))) or real(df, name))
    df = docs(spark, ["a", "b", "a"])
    assert exact_dedup.groups(df).count() == 3
    assert rows and max(n for _, n in rows) <= common.BATCH_ROWS and spark.conf.get(common.BATCHES) == before
    assert exact_dedup.fingerprints(df).columns == ["doc_id", "lang", "source", "_len", "_f1", "_f2"]


def unmoved(spark, df, kept):
    """How many partitions of df come out of `kept` as they were, ids up to 10 left aside."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with lists too long for it
    try:
        parts = lambda x: {tuple(r.ids) for r in x.select("doc_id", F.spark_partition_id().alias("p")).where("doc_id > 10").groupBy("p").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()}
        return len(parts(df) & parts(kept(df)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


@pytest.mark.parametrize("kept", [exact_dedup.dedup, ngram_join.keep_one])
def test_only_listed_rows_move(spark, tmp_path, kept):
    """Texts without a copy are not shuffled, however long the list of copies is."""
    texts = [f"the same {i % 5} words again and again and again" for i in range(10)] + [f"x{i} y{i} z{i} u{i} v{i}" for i in range(10, 400)]
    docs(spark, texts).coalesce(1).sortWithinPartitions("doc_id").repartitionByRange(4, "doc_id").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert kept(df).count() == 395
    assert unmoved(spark, df, kept) == df.rdd.getNumPartitions()


def test_among_loses_no_row(spark):
    df = spark.range(-3000, 7000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("_at")).unionByName(spark.sql("select cast(null as int) k, 2 _at"))
    listed = spark.range(0, 7000, 7).select(F.col("id").alias("z")).union(spark.sql("select cast(null as bigint)"))
    yes, no = ([r.k for r in common.among(df, "k", x, y).collect()] for x, y in ((listed, True), (listed, False)))
    assert {*range(0, 7000, 7), None} <= set(yes) and len(yes) < 1100 and sorted(x for x in yes + no if x is not None) == list(range(-3000, 7000))
    assert common.among(df, "k", listed.limit(0)).count() == 0 and common.among(df, "k", listed.limit(0), False).count() == 10001


# --- n-gram join ---


def shingles(t):
    w = [x for x in (t or "").lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_bucket_counts_take_a_byte_each(spark):
    n = np.arange(1 << 20)
    assert (np.diff(ngram_join.scaled(n).astype(int)) >= 0).all() and (ngram_join.unscaled(ngram_join.scaled(n[:10])) == n[:10]).all()
    assert (np.abs(ngram_join.unscaled(ngram_join.scaled(n)) - n) <= 0.05 * n + 0.5).all() and ngram_join.scaled(np.array([1 << 40])) <= 255
    table = ngram_join.bucket_counts(docs(spark, ["a b c d e f"] * 3 + [None]), "text", 5)
    assert table.nbytes == 1 << 22 and sorted(ngram_join.unscaled(table[table > 0])) == [3, 3]


def test_documents_are_picked_by_a_join_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    df = docs(spark, [str(i) for i in range(50)]).select(F.col("doc_id").alias("doc"), "text")
    names = spark.createDataFrame([(3, 1), (3, 2), (50, 1), (99, 1)], "doc long, to long")
    assert sorted((r.doc, r.text, r.to) for r in ngram_join._chosen(df, names).collect()) == [(3, "2", 1), (3, "2", 2), (50, "49", 1)]


@pytest.mark.parametrize("rounds", [0, 3])
def test_ngram_join_equals_brute_force(spark, rounds):
    r = random.Random(5)
    texts = [None, "", "one two", "One two", "x " * 50]
    for _ in range(12):
        base = words(r, r.randrange(6, 90)).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(5)):
            c = list(base)
            for _ in range(r.randrange(1, 4)):
                c[r.randrange(len(c))] = f"z{r.randrange(99)}"
            texts.append(" ".join(c))
    s = [shingles(t) for t in texts]
    parent, links = list(range(len(s))), [0] * len(s)
    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if n and 100 * n >= 75 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    # small bounds: hot tokens are dealt out, and components take several blocks
    got = {x.doc_id: x for x in ngram_join.similar(docs(spark, texts), star_rounds=rounds, hot=4 if rounds else 1 << 17, block=2 if rounds else 512).collect()}
    assert [(got[i + 1].n_shingles, got[i + 1].component_id, got[i + 1].n_links) for i in range(len(s))] == [(len(s[i]), parent[i] + 1, links[i]) for i in range(len(s))]


def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (9, "q r s t u v")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component_id or 0) for x in ngram_join.similar(df).collect())
    assert got == [(0, 0), (4, 4), (4, 4), (9, 4)]
    assert ngram_join.similar(df.limit(0)).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (22, 21), (5, 5), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 13)} | {20: 20, 21: 20, 22: 20}


def test_a_round_of_components_deals_the_edges_twice(spark):
    e = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 7 % 50).alias("b"))
    plan = components._star(components._star(e, True), False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_components_of_random_graphs(spark):
    for seed, n in enumerate((100, 160, 400)):
        r = random.Random(seed)
        e = [(r.randrange(300), r.randrange(300)) for _ in range(n)]
        e += e[:9] + [(400 + i, 401 + i) for i in range(40)]
        least = {x: x for p in e for x in p if p[0] != p[1]}
        for _ in least:
            for a, b in e:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        got = components.components(spark.createDataFrame(e, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted(least.items())


# --- mixing ---


def test_mix_meets_targets(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, words(r, r.randrange(5, 300)), r.choice(["a", "b", "c", None])) for i in range(300)] + [(999, None, "z"), (None, "x y", "a")], "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.taken)) == sorted(zip(again.doc_id.fillna(-1), again.taken))
    assert (got.taken <= 3 * got["size"]).all()
    got["source"] = got.source.fillna("null")
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 5 * mixing.BLOCK_WORDS
    assert abs(got.groupby("source").target.first().sum() - got["size"].sum()) < 1e-6
    assert mixing.mix(df.limit(0)).count() == 0


# --- pieces ---


def hard_texts():
    r = random.Random(9)
    parts = ["a", "the", " ", "  ", "▁", "\n", "ing", "é", "日本", "😀", "<s>", ".", ",”", "1", "er", "x" * 5, " " * 17, "ﬁ"]
    return [None, "", " ", "a" * 400, " " * 60, "the" * 100] + ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(300)]


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    texts = hard_texts()
    want = {i + 1: sp.encode(t or "") for i, t in enumerate(texts)}
    df = docs(spark, texts)
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(df).collect()} == {k: len(v) for k, v in want.items()}
    out = sentencepieces.decode(sentencepieces.encode(df)).collect()
    for x in out:
        assert (x.ids or []) == want[x.doc_id] and (x.ids is None) == (x.text is None)
        assert x.decoded == (x.text and x.text.replace("▁", " ")) if x.text is not None else x.decoded is None


def test_viterbi_streams_without_cuts():
    """Whole texts as one stream: the same ids, and a window that stays small."""
    import public_tokenizers
    import pyarrow.parquet as pq
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    sp, v = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.lattice(path)
    known = set(v.v.ids)
    for t in hard_texts():
        t = "".join(c for c in t or "" if c == " " or c in known)
        if t:
            assert list(v.stream(v.v.prepared(t))) == sp.encode(t)
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:20]:
        t = "".join(c for c in t or "" if c == " " or c in known)
        if len(t) > 100:
            assert list(v.stream(v.v.prepared(t))) == sp.encode(t)
            assert v.committed >= len(t) / 200 and v.held <= 4 * v.longest


def test_equal_stretches_are_found_in_few_bytes_a_character():
    code = np.random.default_rng(1).integers(97, 100, 300_000).astype(np.uint32)
    start, size = np.arange(0, len(code), 10), np.full(len(code) // 10, 10)
    tracemalloc.start()
    one, place = sentencepieces.Lattice._distinct(None, code, start, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = code.reshape(-1, 10)
    assert (rows[one[place]] == rows).all() and len(one) == len(np.unique(rows, axis=0))
    assert peak < 28 * len(code)


def test_long_and_unbroken_texts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["ab" * 2000, "the cat " * 400_000, None, "日本語" * 500]
    got = sentencepieces._lists(pa.array(texts), path)
    assert [g or [] for g in got.to_pylist()] == [sp.encode(t or "") for t in texts]
    assert sentencepieces.decoded(got, path).to_pylist() == texts
    with pytest.raises(ValueError):
        sentencepieces.decoded(pa.array([[32000]], pa.list_(pa.int32())), path)
    df = spark.createDataFrame([(1, "a b", "x", 2), (1, "a b", "x", 2)], "doc_id long, text string, decoded string, ids int")
    out = sentencepieces.decode(sentencepieces.encode(df))
    assert [x.decoded for x in out.collect()] == ["a b", "a b"] and sentencepieces.encode(df.limit(0)).count() == 0


# --- html ---


def test_html():
    page = """<header>Site</header><div id=menu><a href=x>Home</a></div><article><h1>Head</h1><p>First &amp; long
      paragraph of many words.<p>Second <b>one</b>.</article><div class="comments"><p>Great post, I liked it so very much.</p></div><script>var a="<p>x</p>"</script><footer>&copy; 2020"""
    assert html_extract.main_text(page) == "Head First & long paragraph of many words. Second one."
    assert html_extract.main_text(None) == "" == html_extract.main_text("<p")


def test_cut_is_least():
    r = random.Random(2)
    for _ in range(50):
        n = r.randint(1, 9)
        z = [r.uniform(-2, 2) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if r.random() < 0.4:
                    edges[i][j] = edges[j][i] = r.uniform(0, 1.5)
        cost = lambda s: sum(max(0, z[i]) for i in range(n) if i not in s) + sum(max(0, -z[i]) for i in s) + sum(w for i in range(n) for j, w in edges[i].items() if i < j and (i in s) != (j in s))
        best = min(cost({i for i in range(n) if m >> i & 1}) for m in range(1 << n))
        assert abs(cost(html_extract._source_side(list(range(n)), z, edges)) - best) < 1e-9


# --- substring dedup ---


def test_gear_equals_its_definition():
    data = np.random.default_rng(1).integers(0, 256, 200, dtype=np.uint8)
    want = [sum(int(substring_dedup._GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % (1 << 32) for i in range(200)]
    assert substring_dedup.gear(data).tolist() == want


def test_repeated_passages_go_once(spark):
    r = random.Random(4)
    passage = words(r, 80, 9999)
    own = [words(r, 60, 99999) for _ in range(12)]
    texts = [own[0] + " " + passage + " " + own[1], own[2] + " é " + passage + " " + own[3], own[4], None, ""]
    got = {x.doc_id: x for x in substring_dedup.dedup(docs(spark, texts)).collect()}
    assert got[1].text == texts[0] and got[3].text == texts[2] and got[4].text is None and got[5].text == ""
    assert got[2].removed_words > 50 and got[2].text.startswith(own[2]) and got[2].text.endswith(own[3]) and got[2].shared_with == [1]
    assert got[1].n_repeats >= 1 and got[3].n_repeats == 0
    assert substring_dedup.dedup(docs(spark, ["x"]).limit(0)).count() == 0


def test_passages_against_brute_force(spark):
    """What the bound on a run leaves out shares no 51 words with any text; nearly all
    texts that do are found."""
    r = random.Random(11)
    texts = []
    for k, n in enumerate([18, 24, 30, 51, 60, 120] * 25):
        shared = words(r, n, 99999)
        for _ in range(2 + k % 2):
            texts.append(" ".join((words(r, r.randrange(5, 90), 99999), shared, words(r, r.randrange(90), 99999))))
    grams: dict = {}
    for i, t in enumerate(texts, 1):
        w = t.split()
        for j in range(len(w) - 50):
            grams.setdefault(tuple(w[j : j + 51]), set()).add(i)
    truth = {i for held in grams.values() if len(held) > 1 for i in held}
    df = docs(spark, texts)
    found, loose = ({x.doc for x in substring_dedup.repeats(df, passage=p).select("doc").distinct().collect()} for p in (51, 0))
    assert found <= loose and not (loose - found) & truth
    assert len(found & truth) >= 0.95 * len(truth)
    assert len(found - truth) < 0.7 * len(loose - truth)


# --- language model ---


def test_elias_fano():
    r = np.random.default_rng(3)
    for top, n in ((50, 20), (1 << 40, 500), (1 << 63, 1000), (10, 0)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64))
        e, _ = elias_fano.EliasFano.opened(elias_fano.EliasFano.encoded(v), 0)
        assert e.at(np.arange(len(v))).tolist() == v.tolist()
        q = np.concatenate((v, r.integers(0, top, 50, dtype=np.uint64)))
        where = {int(x): i for i, x in enumerate(v)}
        assert e.find(q).tolist() == [where.get(int(x), -1) for x in q]


def test_trie_equals_a_dictionary():
    r = np.random.default_rng(4)
    held = {int(c): np.unique(r.integers(0, 1 << elias_fano.SUCCESSOR_BITS, n, dtype=np.uint64)) for c, n in zip(np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64)), r.integers(0, 9, 200))}
    contexts = np.array(sorted(held), np.uint64)
    sizes = np.array([len(held[int(c)]) for c in contexts])
    successors = np.concatenate([held[int(c)] for c in contexts])
    log10 = -np.arange(len(successors)) / 512
    trie = elias_fano.Trie(elias_fano.Trie.image(contexts, sizes, successors, log10))
    assert trie.pointers.at(np.arange(201)).tolist() == [0, *np.cumsum(sizes).tolist()]
    want = {(int(c), int(x)): k for k, (c, x) in enumerate(zip(np.repeat(contexts, sizes), successors))}
    asked = [*want, *((int(c), int(x)) for c, x in zip(r.choice(contexts, 500), r.choice(successors, 500))), (5, 5)]
    got = trie.lookup(np.array([c for c, _ in asked], np.uint64), np.array([x for _, x in asked], np.uint64))
    assert got.tolist() == [8 * want[p] if p in want else elias_fano.ABSENT for p in asked]


def test_scores_equal_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", "A b c"] + [words(r, r.randrange(1, 40), 25).upper() for _ in range(60)]
    df = docs(spark, texts).withColumn("held_out", language_id.held_out("doc_id", 5, 1))
    got = lm_score.score(df).collect()
    tokens = {i: (t or "").lower().split() + ["</s>"] for i, t in enumerate(texts, 1)}
    train = [i for i in tokens if not next(x.held_out for x in got if x.doc_id == i)]
    one, two, ctx = {}, {}, {}
    for i in train:
        for a, b in zip(["<s>"] + tokens[i], tokens[i]):
            one[b] = one.get(b, 0) + 1
            two[a, b] = two.get((a, b), 0) + 1
            ctx[a] = ctx.get(a, 0) + 1
    n, v, w = sum(one.values()), len(one), lm_score.PAIR_WEIGHT
    one_ctx = dict(one) | {"<s>": len(train)}
    for x in got:
        t = tokens[x.doc_id]
        p1 = [(one.get(b, 0) + 0.5) / (n + 0.5 * (v + 1)) for b in t]
        full = sum(math.log10((1 - w) * p + w * two.get((a, b), 0) / one_ctx[a]) if one_ctx.get(a) else math.log10(p) for a, b, p in zip(["<s>"] + t, t, p1))
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(b in one for b in t), n)
        assert x.base_score == pytest.approx(sum(map(math.log10, p1))) and x.score == pytest.approx(full, abs=0.0005 * len(t))
    assert lm_score.score(df.limit(0)).count() == 0


def test_a_block_takes_few_bytes_a_token():
    r = np.random.default_rng(5)
    texts = pa.array([" ".join(map(str, x)) for x in r.integers(0, 5000, (200, 2000))])
    table = pa.table({"text": texts, "held_out": pa.array(r.random(200) < 0.2)})
    tracemalloc.start()
    b = lm_score.Block(table)
    b.total, b.only_here, b.n = b.counts, np.zeros(len(b.words), bool), int(b.counts.sum())
    b.pair(16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b.words[b.place[: b.sizes[0]]].tolist()[-1] == lm_score.END and b.counts.sum() == b.counted.sum() == b.pair_counts.sum()
    assert (b.one[b.pair_place] == np.insert(b.place[:-1], 0, 0))[np.setdiff1d(np.arange(len(b.place)), b.first)].all() and (b.two[b.pair_place] == b.place).all()
    assert peak < 80 * len(b.place)


# --- language ---


def test_marginals_equal_brute_force():
    import itertools

    r = np.random.default_rng(2)
    e, t = r.normal(size=(7, 3)), r.normal(size=(3, 3))
    language_id.BLOCK_WORDS, keep = 2, language_id.BLOCK_WORDS
    try:
        p, _ = language_id.marginals(e, np.array([0, 5, 5, 7]), t)
    finally:
        language_id.BLOCK_WORDS = keep
    for lo, hi in ((0, 5), (5, 7)):
        total = np.zeros((hi - lo, 3))
        for y in itertools.product(range(3), repeat=hi - lo):
            w = math.exp(sum(e[lo + i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            for i, k in enumerate(y):
                total[i, k] += w
        assert np.allclose(p[lo:hi], total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_language_id_edges_and_code_switching(spark):
    en, de = "the of and that with this house " * 12, "der die und nicht schön haus über " * 12
    df = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(20)] + [(90, None, "en"), (91, "12 34 !!", None), (92, "", "de")], "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 90, 91, 92)] == ["de", "en", "und", "und", "und"] and got[90].score == 0
    p, _ = next(iter(language_id.label_words(model, pa.array([en + de]))))
    half = len(p) // 2
    assert (p[: half - 2].argmax(axis=1) == 1).all() and (p[half + 2 :].argmax(axis=1) == 0).all()
    assert {x.lang_pred for x in language_id.predict(df.limit(3), language_id.train(df.limit(0))).collect()} == {"und"}


# --- neighbours ---


def neighbour_recall(x, ids, got, k):
    x, hits, asked = x.astype(np.float64), 0, sorted(set(got.query_id))
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9e9
        want = sorted(range(len(x)), key=lambda i: (-s[i], i))[:k]
        hits += len(set(want) & set(g.vec_id))
        g = g.sort_values("rank")
        assert np.allclose(g.score, s[g.vec_id]) and list(g["rank"]) == list(range(1, len(g) + 1)) and list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
    assert asked == ids
    return hits / (k * len(ids))


def test_neighbours(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[50] = x[60]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (None, [1.0] * 16), (3, x[3].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    # all queries are probes: a recall of 1 is exact; several shards and blocks
    for recall, shard, block in ((1.0, 4096, 8192), (1.0, 64, 7), (0.7, 64, 8192)):
        got = ann.nearest(df, is_query=F.col("id") % 20 == 0, k=5, recall=recall, shard_rows=shard, query_rows=block).toPandas()
        assert set(got.groupby("query_id").size()) == {5} and len(got) == 100
        assert neighbour_recall(x, list(range(0, 400, 20)), got, 5) >= recall
    assert ann.nearest(df.limit(0), is_query=F.lit(True)).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), is_query=F.lit(True)).toPandas()
    assert len(few) == 6


def test_forest_meets_only_a_part():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 32))
    x[1500:] = x[:1500] + 0.1 * r.normal(size=(1500, 32))
    forest = ann.Shard(np.arange(3000), x, np.sqrt((x**2).sum(axis=1).max()), ann.TREES, ann.SEED)
    asked = forest.asked(x[:50])
    level = forest.levels(asked, 100)
    for q, who in enumerate(forest.candidates(asked, 100, 1)):
        assert len(who) < 1500
        n = lambda at: sum(int((s >> np.uint64(64 - at) == a[q] >> np.uint64(64 - at)).sum()) for s, a in zip(forest.plain, asked))
        assert n(int(level[q])) >= 100 > n(int(level[q]) + 1)
    assert len(set(level.tolist())) > 1


def test_neighbours_beside_a_cluster(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(5000, 64))
    x[:2500] = x[0] / np.linalg.norm(x[0]) + 0.3 / 8 * x[:2500]  # near copies
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, is_query=F.col("id") % 25 == 0, k=20).toPandas()
    assert neighbour_recall(x, list(range(0, 5000, 25)), got, 20) >= 0.9


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(6)
    en, de = "the of and that with this house tree".split(), "der die und nicht schön haus über baum".split()
    text = lambda v: " ".join(r.choice(v) + str(r.randrange(60)) for _ in range(60))
    rows = [(i, text(en if i % 2 else de), "en" if i % 2 else "de", f"s{i % 4}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "de", "s1", 0), (101, rows[1][1] + " end", "en", "s1", 0), (102, None, None, None, 0), (103, "11 22", None, "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, left = df, []
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, str(tmp_path)), name)
        left.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert left[0] == set(range(40)) | {100, 101}
    assert left[1] == left[0] - {0}
    assert left[2] == left[1] - {101}
    assert left[3] <= left[2] and docs.where("not round_trip").count() == 0
    assert P.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_take_small_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P
    from pyspark.sql import DataFrame

    seen, real = tmp_path / "seen", DataFrame.mapInArrow

    def spied(df, work, schema, *a, **b):
        def run(batches):
            def told():
                for x in batches:
                    with open(seen, "a") as f:
                        f.write(f"{x.num_rows}\n")
                    yield x

            yield from work(told())

        return real(df, run, schema, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", spied)
    r = random.Random(8)
    rows = [(i, "the of and that " + words(r, 12, 5000), "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in P.STAGES:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            seen.write_text("")
            docs = P.stored(stage(spark, docs, str(tmp_path)).coalesce(1), name)
            assert all(int(x) <= 1024 for x in seen.read_text().split()), name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_tasks_give_back_what_they_freed(spark):
    from tidemark.llm.common import released

    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024

    def work(batches):
        for b in batches:
            many = [np.ones(2000) for _ in range(8000)]  # 122 MB in pieces too small to be mapped apart
            kept = [x[0] for x in many[::100]]
            yield pa.RecordBatch.from_arrays([pa.array([rss() + 0 * len(kept)])], ["mb"])

    one = spark.range(1, numPartitions=1)
    used = one.mapInArrow(released(work), "mb long").first().mb
    after = one.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([rss()])], ["mb"]) for _ in batches), "mb long").first().mb
    assert after < used - 80


# --- columns of clashing names, empty tables, a huge text ---

CLASH = ("score", "lang_pred", "spans", "_gone", "gone", "_sha", "_d", "_s", "_n", "_kept", "_letter", "letter", "ids", "doc", "row", "twice", "n", "g", "source_size", "_copy", "_copies", "_times", "_all", "_id", "_text")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


def untouched(out, but=()):
    return all(x[c] == f"own {c}" for x in out.collect() for c in CLASH if c in out.columns and c not in but)


def test_clashing_columns_pass_through(spark):
    import corpus_pipeline as P

    en, de = "the of and that with this house " * 12, "der die und nicht schön haus über " * 12
    df = clashing(spark, [(i, (en if i % 2 else de) + f" t{i % 5}", "en" if i % 2 else "de", f"s{i % 3}") for i in range(12)] + [(50, None, None, None)])
    found = language_id.predict(df, language_id.train(df))
    assert found.count() == 13 and untouched(found, ("score", "lang_pred"))
    for out in (exact_dedup.dedup(df), ngram_join.keep_one(df), substring_dedup.dedup(df)):
        assert out.count() and untouched(out, ("spans",)) and set(df.columns) <= set(out.columns)
    assert untouched(sentencepieces.encode(df), ("ids",))
    assert mixing.mix(df).count() == token_counts.count_tokens(df).count() == ngram_join.similar(df).count() == exact_dedup.groups(df).count() == 13
    assert lm_score.score(df.withColumn("held_out", F.lit(False))).count() == 13
    pages = df.select("*", F.col("text").alias("html"))
    assert untouched(html_extract.extract(pages, text="main"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.count() and untouched(out)
    assert P.STAGES[-1][1](spark, df, "").count() == 13


def test_empty_tables(spark):
    import corpus_pipeline as P

    df = docs(spark, ["x"]).limit(0)
    assert sentencepieces.decode(sentencepieces.encode(df)).count() == 0 == token_counts.count_tokens(df).count()
    assert html_extract.extract(df.withColumn("html", F.col("text"))).count() == 0
    model = language_id.fit(["the house", "das haus"], ["en", "de"])
    assert language_id.predict(df, model).count() == 0
    for _, stage in P.STAGES:
        assert stage(spark, df, "").count() == 0


def test_languages_are_learned_from_whole_texts_up_to_a_bound(spark):
    df = spark.createDataFrame([(1, "the house " * 100, "en"), (2, "das haus " * 10, "de"), (3, "le maison " * 1000, "fr")], "doc_id long, text string, lang string")
    assert language_id.train(df, label_bytes=2000).labels == ["de", "en"]
