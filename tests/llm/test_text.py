"""Tokenizer, rules, mixing, sharding, toxicity and HTML against brute force or held-out cases."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests_llm_odd import ODD
from tidemark.llm import boosting, bpe, html_blocks, html_extract, mixing, quality_rules, sharding, toxicity
from tidemark.llm.lstm import Labeller, padded

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(make, prose, reference):
    texts = [*ODD, "it's  we'll\n\n x  ", "=" * 900, "aaab" * 40, "1d10t 3.14159 foo_bar", " lead", "tail \n", "a b c \u0085 d", *prose(6, 30), "<|endoftext|>"]
    got = {r.doc_id: r for r in bpe.round_trip(make(texts).withColumn("ids", F.lit(0)), PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_columns(make):
    df = make(["hello world", None])
    ids = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert ids.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    assert [bytes(r.bytes) for r in bpe.decode(ids, PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == [b"hello world", b""]
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def brute_quality(t):
    w = WORD.findall(t or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(make, prose):
    texts = prose(7, 60, 5, 80, 12) + [*ODD, "a b c d e f g h " * 9, "x\nx\n\nx\n \n", "#$% & <a> |*", "the of and to in " * 30]
    got = {r.doc_id: r for r in quality_rules.judge(make(texts).withColumn("n_words", F.lit(0))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
        assert not (r.base_failed and r.kept)


def test_quality_distance(spark):
    good = "The cat of the town and a dog in it was for the man, as that is on the way to be with us by now. " * 3
    rows = [(i, good + f"More {i} words.", "en") for i in range(30)] + [(90, "##$$ %%&& " * 60 + "one two", "en"), (91, good, None), (92, good, "xx")]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string").drop_duplicates()
    text = lambda i: " ".join(f"{w}{i}{k}" for k, w in enumerate(["zz", "qq"] * 60))
    df = df.unionByName(spark.createDataFrame([(93, text(3), "en")], df.schema))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[90].class_distance > quality_rules.MAX_CLASS_DISTANCE and not got[90].kept
    assert got[93].word_distance > quality_rules.MAX_WORD_DISTANCE and not got[93].kept and not got[93].base_failed
    assert got[91].class_distance is None and got[92].class_distance is None
    assert quality_rules.judge(df.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [200, 1500])
def test_sharding(make, prose, limit):
    texts = prose(8, 200, 1, 40) + ODD + ["long " * 500]
    rows = sharding.assign(make(texts).withColumn("shard", F.lit("clash")), limit).collect()
    assert len(rows) == len(texts)
    held = Counter()
    for r in rows:
        bits = f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}"
        assert r.n_bytes == len((texts[r.doc_id] or "").encode()) and bits[: r.depth] == r.shard
        held[r.shard] += r.n_bytes
    shards = {r.shard: r for r in rows}
    assert all(held[s] == r.shard_bytes and (held[s] <= limit or r.shard_docs == 1) for s, r in shards.items())
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    parents = Counter()
    for s in shards:
        for k in range(len(s)):
            parents[s[:k]] += held[s]
    assert all(n > limit for n in parents.values())  # nothing was split that fitted


def test_sharding_pages_a_repeated_id(make):
    rows = sharding.assign(make([(7, "x" * 40)] * 50 + [(None, None), (1, "a")]), 100).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.n_bytes
    assert len(rows) == 52 and max(sizes.values()) <= 100
    assert sharding.assign(make([(1, "a")]).limit(0)).collect() == []


def brute_mix(docs, plan):
    """Target by leaf, sharing out by repeated capping."""

    def share(budget, children):
        out, left, open_ = {}, budget, dict(children)
        while open_:
            total = sum(w for w, _ in open_.values())
            full = {k for k, (w, c) in open_.items() if c <= left * w / total + 1e-9}
            if not full:
                return out | {k: left * w / total for k, (w, _) in open_.items()}
            for k in full:
                out[k] = open_.pop(k)[1]
            left = budget - sum(out[k] for k in out)
        return out

    avail = Counter()
    for d, l, s, n in docs:
        avail[d, l, s] += n
    supply = lambda *key: plan.max_epochs * sum(n for k, n in avail.items() if k[: len(key)] == key)
    weight = lambda names, k: names.get(k, 1)
    target, budget = {}, sum(avail.values()) * plan.budget_num // plan.budget_den
    for d, b in share(budget, {d: (weight(plan.domains, d), supply(d)) for d in {k[0] for k in avail}}).items():
        for l, c in share(b, {l: (weight(plan.languages, l), supply(d, l)) for l in {k[1] for k in avail if k[0] == d}}).items():
            for s, t in share(c, {s: (weight(plan.sources, s), supply(d, l, s)) for s in {k[2] for k in avail if k[:2] == (d, l)}}).items():
                target[d, l, s] = t
    return avail, target


@pytest.mark.parametrize("plan", [mixing.PLAN, mixing.MixPlan(domains={"web": 9}, sources={"src1": 5}, budget_num=3, budget_den=2, slice_bits=3), mixing.MixPlan(budget_num=5)])
def test_mixing(spark, prose, plan):
    texts = prose(9, 300, 1, 30)
    rows = [(i, t, ["en", "de", None][i * i % 3], f"src{i * i % 17}" if i % 50 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(900, None, "en", "src1"), (901, "", "fr", "odd")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, plan).collect()
    assert len(got) == df.count()
    avail, target = brute_mix([(r.domain, r.lang, r.source, r.n_tokens) for r in got], plan)
    taken, copies = Counter(), {}
    for r in got:
        assert abs(r.target - target[r.domain, r.lang, r.source]) <= 1
        taken[r.domain, r.lang, r.source] += r.copies * r.n_tokens
        copies.setdefault((r.domain, r.lang, r.source), set()).add(r.copies)
    for leaf, t in target.items():
        assert t - max(r.n_tokens for r in got) - 1 <= taken[leaf] <= t + 1
        assert max(copies[leaf]) - min(copies[leaf]) <= 1  # whole epochs and one prefix
    drawn = mixing.draw(df, plan)
    assert drawn.columns == df.columns and drawn.count() == sum(r.copies for r in got)


def test_mixing_edges(make):
    assert mixing.mix(make(["a"]).limit(0)).collect() == []
    assert [r.copies for r in mixing.mix(make([(1, "a b"), (1, "a b")]), mixing.MixPlan(budget_num=1, budget_den=1)).collect()] == [1, 1]


def test_mixing_takes_no_pass_too_many(spark):
    rows = [(i, "" if i % 5 == 0 else "a b c", "en", "src1") for i in range(60)] + [(7, "x y", "fr", "src9"), (99, None, "es", "odd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("__id", F.lit(1)).withColumn("copies", F.lit(2))
    plan = mixing.MixPlan(budget_num=5, budget_den=1, max_epochs=2)
    assert {r.copies for r in mixing.mix(df, plan).where("doc_id <> 99").collect()} == {2}
    drawn = mixing.draw(df, plan)
    assert drawn.columns == df.columns and drawn.count() == 2 * 61  # id 7 stands in two leaves


def test_toxicity_scores_do_not_depend_on_partitions(spark, prose):
    rows = [(i, t + " moron moron" * (i % 4 == 0)) for i, t in enumerate(prose(13, 300, 10, 40))]
    docs = spark.createDataFrame([*rows, (5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    scores = [{(r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, toxicity.train(docs.repartition(n), labels)).collect()} for n in (1, 5)]
    assert scores[0] == scores[1]


def test_toxicity_learns_words_and_stems(spark, prose):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i, t in enumerate(prose(10, 900, 20, 80)):
        toxic = i % 6 == 0
        if toxic:
            words = t.split()
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), ["you", "m0ron", "Grumpy" + "xyz"[int(rng.integers(3))], "moron"][int(rng.integers(1, 4))])
            t = " ".join(words)
        rows.append((i, t, "en"))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(2000, None, "en"), (2001, "", "en"), (None, "hello", "en")], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 900]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    none = toxicity.train(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_isotonic_and_trees():
    knots, levels = boosting.fit_isotonic(np.array([1, 2, 3, 4, 4.0]), np.array([0, 1, 0, 1, 1.0]))
    assert knots.tolist() == [1, 2, 3, 4] and levels.tolist() == [0, 0.5, 0.5, 1]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    margin = boosting.fit_trees(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == y[1500:]).mean() > 0.95


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="top"><ul class="site-links"><li><a href=x>Home</a><li><a href=y>News</a></ul></div><!-- ad --><article><h1>A &amp; B</h1><p><b>First
 para &lt;ok&gt;.<br><p>Second&nbsp;one.</p><div class="ad">Buy now</div></article><div class="user-comments"><p>I think so too, thanks for it all.</p></div><footer>&copy; x</footer>"""


def test_blocks():
    got = [b.text for b in html_blocks.blocks(PAGE)]
    assert got == ["Home", "News", "A & B", "First para <ok>.", "Second one.", "Buy now", "I think so too, thanks for it all.", "© x"]
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("a < b <!-- x")] == ["a < b"]


def test_lstm_gradients():
    model, rng = Labeller(3, 4, 1), np.random.default_rng(2)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, mask = padded([rng.normal(size=(n, 3)) for n in (5, 2, 7)])
    y = (rng.random(x.shape[:2]) > 0.5).astype(float)
    _, grad = model.gradients(x, mask, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        model.p[name][at] += 1e-4
        up = model.gradients(x, mask, y)[0]
        model.p[name][at] -= 2e-4
        down = model.gradients(x, mask, y)[0]
        model.p[name][at] += 1e-4
        assert g[at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-5)


def test_html_extract(spark, prose):
    layouts = html_extract.Layouts([t.capitalize() + "." for t in prose(11, 200, 15, 60)], [t for t in prose(12, 100, 1, 4)], 77)
    df = spark.createDataFrame([(i, f"u{i}", layouts.page()) for i in range(120)] + [(500, "u", PAGE), (501, None, None), (502, "v", "")], "page_id long, url string, html string")
    bare = df.withColumn("html", F.translate("html", html_extract.ARTICLE + html_extract.OTHER, ""))
    model = html_extract.train(bare.where("page_id < 60"))
    clean = lambda t: t.replace(html_extract.ARTICLE, "").replace(html_extract.OTHER, "")
    pages = {r.page_id: r.html for r in df.collect()}
    got = {r.page_id: r for r in html_extract.extract(bare, model).collect()}
    held = range(60, 120)
    exact = [got[i].text == "\n".join(clean(b.text) for b in html_blocks.blocks(pages[i]) if html_extract.ARTICLE in b.text) for i in held]
    assert np.mean(exact) > 0.7
    assert got[500].text == "A & B\nFirst para <ok>.\nSecond one."
    assert got[501].text == "" and got[502].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(df.limit(0), model).collect() == []


def test_write_shards(spark, make, tmp_path):
    """Each row lies in the folder of its shard: repeats of one id are spread, columns that clash keep their values."""
    rows = [(7, "x" * 100)] * 40 + [(i, "y" * (i % 50)) for i in range(200)] + [(None, "z" * 90), (None, None), (999, "w" * 5_000)]
    table = make(rows).withColumnRenamed("n_chars", "shard").withColumn("__row", F.lit("kept"))
    name = sharding.write_shards(table, str(tmp_path / "out"), limit=1_000)
    back = spark.read.option("inferSchema", "false").parquet(str(tmp_path / "out"))
    assert name not in table.columns and set(back.columns) == {*table.columns, name}
    assert sorted(map(repr, back.select(table.columns).collect())) == sorted(map(repr, table.collect()))
    sizes = back.groupBy(name).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"), F.count("*").alias("n")).collect()
    assert all(r["size"] <= 1_000 or r.n == 1 for r in sizes) and len([r for r in sizes if r["size"] > 1_000]) == 1
    assert back.where("doc_id = 7").select(name).distinct().count() >= 4
