"""Each operator against brute force, exact round trips or held-out accuracy; and its defined edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF, plain

from tidyspark.llm import fingerprints, langid, mixing, neardup, packing, quality_model, quality_rules, textvec, toxicity, urls, warc
from tidyspark.llm.common import WORD
from tidyspark.llm.queries import ORACLES, QUERIES

LONG = " ".join(f"w{i}" for i in range(30_000))
EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "one two", "de", "b"), (4, "one two", "de", "b"), (5, LONG, "en", "a"), (None, "nobody knows this", "en", None), (6, "ÄÖ ß\u00a0x 王", "fr", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    # further columns with names the operators use themselves
    return df.withColumns({"size": F.lit("x"), "key": F.lit(1), "score": F.lit("?"), "bucket": F.lit(0.5), "n_chars": F.lit(7)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert plain(got.select(*cols).toPandas().astype(object).itertuples(index=False)) == plain(want[cols].astype(object).itertuples(index=False))


def test_packing_is_exact(spark, docs, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = QUERIES["op1_packing"](spark, SF).toPandas().sort_values(["doc_id", "start"])
    assert sorted(got.sequence_id) == list(range(len(got))) and (got.offset == 0).all()
    assert (got.length & (got.length - 1) == 0).all() and got.length.max() <= 2048
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in got[got.doc_id == doc_id].itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_fast_tokenizer_equals_full(path):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    fast = packing.FastTokenizer(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=" \n\tabé's1.<|>\u00a0\u3000王", max_size=40))
    def same(text):
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()
    assert fast.ids("<|endoftext|>") != np.array([50256], "<u4").tobytes()


def test_packing_edges(spark, edge, empty, path):
    got = packing.pack_documents(edge, path).toPandas()
    assert got[got.doc_id.isin([1, 2])].length.tolist() == [1, 1]
    assert len(got[got.doc_id == 4]) == 2 * len(packing.cut(int(got[got.doc_id == 4].doc_tokens.iloc[0])))
    assert packing.pack_documents(empty, path).count() == 0
    with_ids = packing.pack_documents(edge, path, with_ids=True).toPandas()
    assert all(zlib.crc32(bytes(i)) == c for i, c in zip(with_ids.ids, with_ids.ids_crc32))


def test_mixing(spark, edge, empty):
    plan = mixing.mix_plan(mixing._rows(edge, "text", "doc_id", "source")).toPandas()
    assert len(plan) == len(EDGE) and (plan.taken <= 2 * plan["size"]).all()
    by = plan.groupby(plan.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 1).all()
    mixed = mixing.mix_documents(edge)
    assert mixed.columns == edge.columns
    assert sum(len(re.findall(WORD, r.text)) for r in mixed.collect()) == plan.taken.sum()
    assert mixing.mix_documents(empty).count() == 0


def test_mixing_positions_follow_schedule(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'a b c d e' as text", "'s' || id % 3 as source")
    mixed = [r.source for r in mixing.mix_documents(df).collect()]
    half = len(mixed) // 2
    assert mixed[:half].count("s0") > 1.3 * mixed[half:].count("s0") and mixed[half:].count("s2") > 1.3 * mixed[:half].count("s2")
    plan = mixing.mix_plan(mixing._rows(df, "text", "doc_id", "source"))
    again = mixing.mix_plan(mixing._rows(df.repartition(7), "text", "doc_id", "source"))
    assert sorted(map(tuple, plan.select("doc_id", "taken").collect())) == sorted(map(tuple, again.select("doc_id", "taken").collect()))


PAGES = [(5, "http://www.A.com/x?q=1", "same"), (3, "http://b.org", "same"), (9, "http://b.org", "same"), (1, None, None), (2, "no scheme", ""), (3, "http://b.org", "same"), (None, "http://c.net/", "same"), (4, "https://u@h.net:8080/a b#f", "größe 王" * 5000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as key", "1 as at")
    archive = warc.write_archive(pages, block_lines=2)
    got = warc.read_captures(archive, pages).collect()
    assert len(got) == len(PAGES)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("5", "revisit", 3), ("3", "response", None), ("3", "response", None), ("9", "revisit", 3), ("1", "response", None), ("2", "revisit", 1), ("None", "revisit", 3), ("4", "response", None)], key=lambda k: (k[0], k[1], str(k[2])))
    big = next(r for r in got if r.page_id == 4)
    assert bytes(big.payload).decode() == PAGES[-1][2] and big.payload_bytes == len(PAGES[-1][2].encode())
    some = warc.read_captures(archive, pages.filter("page_id in (3, 9)"))
    assert sorted(r.page_id for r in some.collect()) == [3, 3, 9]
    assert warc.read_captures(archive, spark.createDataFrame([(77, "http://none.org")], "page_id long, url string")).count() == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_captures(warc.write_archive(none), none).count() == 0
    kept = warc.write_archive(pages, min_revisit_bytes=1)
    assert {r.page_id: r.record_type for r in warc.read_captures(kept, pages).collect()}[2] == "response"


def test_surt():
    assert warc.surt("http://www.A.com:80/p?q#f") == "com,a,www:80)/p?q"
    assert warc.surt(None) == "" and warc.surt("x") == "x"


def test_langid(spark, edge, empty, duck):
    got = QUERIES["op4_langid"](spark, SF).toPandas()
    truth = duck.execute("select doc_id, lang from documents").df()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()
    model = langid.fit(["the cat is on the mat"] * 30 + ["der hund ist im haus"] * 30, ["en"] * 30 + ["de"] * 30)
    rows = edge.select("doc_id", langid.identify(model, edge["text"]).alias("p")).collect()
    assert {r.p.lang for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert (model.weights != 0).mean() < 0.05
    assert langid.train(empty) is None and langid.predict(None, ["x"])[0] == ["und"]


def test_quality_classifier(spark, edge, empty, duck):
    got = QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    import duckdb

    lab = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df()
    held = got[got.held_out].merge(lab, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9
    model = quality_model.fit([], [])
    assert quality_model.predict(model, [None, "", "a"]).tolist() == [0.5] * 3
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert np.allclose(quality_model.predict(quality_model.train(edge, labels), ["x"]), 0.5)
    assert empty.select(quality_model.quality(model, empty["text"])).count() == 0


def _toxic_recall():
    """Of one half of sf0.1's labelled rows, learned from the other: recall, recall of those that can be told, false alarms.

    About one toxic row in eight holds no word that only toxic rows have, but for the filler of its language: such a label
    can't be learned, so recall over all of them stays below 0.9 whatever the method.
    """
    import duckdb

    rows = duckdb.sql("select text, quality, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by doc_id").fetchall()
    train, test = rows[::2], rows[1::2]
    words = lambda text: set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    seen: dict = {}
    for text, _, toxic in train:
        for w in words(text):
            seen.setdefault(w, [0, 0])[toxic] += 1
    telling = {w for w, (clean, toxic) in seen.items() if toxic >= 8 and clean == 0}
    model = toxicity.fit([r[0] for r in train], np.array([[1 - r[1], r[2]] for r in train]))
    p = toxicity.predict(model, [r[0] for r in test])[:, 1] >= toxicity.THRESHOLD
    y = np.array([r[2] for r in test]) == 1
    told = np.array([bool(words(r[0]) & telling) for r in test])
    return p[y].mean(), p[y & told].mean(), p[~y].mean()


def test_toxicity(spark, edge, empty):
    recall, told, alarms = _toxic_recall()
    assert recall > 0.85 and told > 0.95 and alarms < 0.01
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject_toxic(edge, labels)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)
    assert toxicity.reject_toxic(empty, labels).count() == 0


URLS = [("http://a.com/x", "a.com", "/x", "com/", "allow"), ("HTTP://WWW.Example.COM/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"), ("http://b.example.com/en/z#f", "b.example.com", "/en/z", "example.com/en/", "block"), ("http://n.net/es/1", "n.net", "/es/1", "net/es/", "block"), ("http://a.com", "a.com", "", None, None), (None, "", "", None, None), ("a.com/x", "", "", None, None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("x://h://y/z", "h:", "//y/z", None, None)]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "z") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_url_trees_learn():
    bad = [f"http://x{i}.bad.net/{i * 7919}?a=1&b=2&c={i}" for i in range(300)]
    good = [f"http://site{i}.good.org/about/team" for i in range(300)]
    parts = lambda us: ([u.split("/")[2] for u in us], ["/" + u.split("/", 3)[3].split("?")[0] for u in us])
    train, test = bad[:200] + good[:200], bad[200:] + good[200:]
    model = urls.fit(train, *parts(train), np.array([1.0] * 200 + [0.0] * 200))
    p = urls.predict(model, test, *parts(test))
    assert (p[:100] > 0.5).all() and (p[100:] < 0.5).all()


def _paragraphs(text):
    return {line[i : i + 512] for line in (text or "").split("\n") if line for i in range(0, len(line), 512)}


def _jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def _check_fingerprints(docs, got):
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), []).append(r)
    for i, (doc_id, text) in enumerate(docs):
        text, nxt = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        want = (hashlib.sha256(edited.encode()).hexdigest(), round(_jaccard(_paragraphs(text), _paragraphs(edited)), 9), round(_jaccard(_paragraphs(text), _paragraphs(nxt)), 9))
        assert want in [(r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in by[(doc_id, len(text))]]


def test_fingerprints_equal_brute_force(spark, docs):
    _check_fingerprints(docs, QUERIES["op7_fingerprints"](spark, SF).collect())


def test_fingerprint_edges(spark, empty):
    long = "\n".join(f"line {i} of a long text" for i in range(60))
    data = [(1, None), (2, "a\nb\na"), (3, long), (7, ""), (9, long + "\nmore"), (10, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = fingerprints.compare(fingerprints.with_next(df)).collect()
    _check_fingerprints(data, got)
    one = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    r = fingerprints.compare(fingerprints.with_next(one)).first()
    assert r.near_next == 1.0 and fingerprints.compare(fingerprints.with_next(empty)).count() == 0
    twice = spark.createDataFrame([(1, "p\nq"), (1, "p\nq"), (None, "p\nq")], "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprints.compare(fingerprints.with_next(twice)).collect()}) == 1


def test_fingerprint_of_many_lines(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(900))
    data = [(3, long), (9, long + "\nmore")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    _check_fingerprints(data, fingerprints.compare(fingerprints.with_next(df)).collect())


def _shingle_jaccard(a, b):
    """Likeness by all runs of three words, which knows nothing of the operator's cuts."""
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    return _jaccard(runs(a), runs(b))


def test_pieces_follow_a_likeness_without_cuts(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{j}" for j in rng.integers(0, 10**6, n)) for n in (40, 60, 90, 130, 400, 1500)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for r in fingerprints.compare(fingerprints.with_next(df)).collect():
        text, nxt = lines[r.doc_id], lines[(r.doc_id + 1) % len(lines)]
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        assert abs(r.near_edited_pieces - _shingle_jaccard(text, edited)) < 0.2 and r.near_edited_pieces > 0
        assert r.near_next_pieces == _shingle_jaccard(text, nxt) == 0
    hexes = "".join(f"{j:08x}" for j in rng.integers(0, 2**32, 300))
    pairs = [(lines[5], "an insertion at the start " + lines[5]), (lines[4], lines[4][:900] + " some more words " + lines[4][900:]), (hexes, "abc" + hexes)]
    both = spark.createDataFrame(pairs, "x string, y string").select(fingerprints.pieces(F.col("x")).alias("a"), fingerprints.pieces(F.col("y")).alias("b"))
    both = both.selectExpr("*", "size(a) + size(b) as n").withColumn("d", fingerprints.apart("a", "b"))
    assert all(1 - 2 * r.d / (r.n + r.d) > 0.8 for r in both.collect())


def test_quality_rule_edges(spark, edge, empty):
    ledger = quality_rules.apply_policy(quality_rules.rule_ledger(edge)).collect()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in ledger if r.doc_id in (1, 2, 3))
    big = next(r for r in ledger if r.doc_id == 5)
    assert big.n_words == 30_000 and big.n_repeat_words == 0
    assert quality_rules.keep_by_policy(edge).columns == edge.columns
    assert quality_rules.rule_ledger(empty).count() == 0 and quality_rules.ablations(quality_rules.rule_ledger(empty)).count() == 0


def test_repeated_windows(spark):
    words = "a b c a b c a x y z q a b c".split()
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a a a a"), (3, "a a a")], "doc_id long, text string")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    want = len({j for i, g in enumerate(tri) if tri.count(g) > 1 for j in range(i, i + 3)})
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measures(df).collect()}
    assert got == {1: want, 2: 4, 3: 0}


def test_ablations(spark):
    ledger = quality_rules.rule_ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    bits = [r.failed_bits for r in ledger.select("failed_bits").collect()]
    for r in quality_rules.ablations(ledger).collect():
        bit = 1 << quality_rules.RULES.index(r.rule)
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def _classes(docs):
    """Components of the containment relation, by brute force over all pairs."""
    sets = []
    for _, part in textvec.chunks([t for _, t in docs]):
        h, b = neardup.shingle_sets(part)
        sets += [h[b[i] : b[i + 1]] for i in range(len(part))]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sorted((sets[i], sets[j]), key=len)
            if len(b) == 0 or (len(a) and len(b) <= neardup.MAX_RATIO * len(a) and len(np.intersect1d(a, b)) >= 0.8 * len(a)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(docs))]


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_duplicates"](spark, SF).collect()}
    assert got == {d[0]: docs[r][0] for d, r in zip(docs, _classes(docs))}


def test_near_duplicate_edges(spark, edge, empty):
    got = neardup.near_duplicates(edge)
    assert got.count() == len(EDGE)
    by = {r.doc_id: r.class_id for r in got.collect()}
    assert by[1] == by[2] == by[3] and by[4] == 4 and by[5] == 5
    kept = neardup.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == 5
    assert neardup.near_duplicates(empty).count() == 0


def test_one_document_a_class_whatever_the_ids(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcdef"]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (None, texts[5]), (9, None), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in neardup.keep_one(df).collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[5]), (9, None)], key=str)


def test_full_buckets_lose_nothing(spark):
    """More near copies of one text than a bucket has anchors, each differing from the others."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(200)]
    data = [(0, " ".join(base))]
    for k in range(1, 120):
        words = list(base)
        for j in rng.choice(200, 3, replace=False):
            words[j] = f"x{k}_{j}"
        data.append((k, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = _classes(data)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {d[0]: data[r][0] for d, r in zip(data, want)}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name != "mixing":
            assert docs.count() <= n
            n = docs.count()
    assert p.STAGES[-1][1](spark, docs, SF).count() > 0


def test_pipeline_run(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).count() > 0
