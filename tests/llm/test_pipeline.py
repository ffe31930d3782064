"""The stages, each on its own input, and the whole run."""

import corpus_pipeline
from rivulet.llm import decontam, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        seen.append(docs)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    assert ids[1] == {r.doc_id for r in quality.assess(seen[0]).where("kept").collect()}
    leaks = {r.doc_id for r in decontam.find(seen[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - leaks and ids[4] == ids[3]
    texts = [r.text for r in seen[2].collect()]
    assert len(texts) == len(set(texts))
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids[4]


def test_stages_on_odd_input(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, edge_docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        out.collect()


def test_near_duplicates_of_whole_groups(spark):
    """Of rows in groups whose five-word similarity is 0.9 or more, one stays; unlike rows all stay."""
    import random

    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    rows, k = [], 0
    for _ in range(60):
        base = [r.choice(words) for _ in range(300)]
        for _ in range(4):
            w = list(base)
            w[r.randrange(300)] = r.choice(words)
            rows.append((k, " ".join(w), "en", "s", 0))
            k += 1
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    kept = {x.doc_id for x in out.collect()}
    assert {4 * g for g in range(60)} <= kept and len(kept) <= 63


def test_last_stage_decodes_its_ids(spark, edge_docs):
    import hashlib

    got = corpus_pipeline.tokens(spark, edge_docs, SF).select("doc_id", "decoded_sha256").collect()
    want = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_similar_against_brute_force(spark):
    """Components are those of links at a cosine of 0.8, and no pair with a Jaccard similarity of 0.8 is lost."""
    import random

    import numpy as np

    from rivulet.llm import simhash

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = [x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for g in range(80):
        base = [r.choice(words) for _ in range(r.choice((60, 150, 400)))]
        for _ in range(r.choice((2, 3, 9))):
            w = list(base)
            for _ in range(r.randrange(1, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.root for x in simhash.similar(df).collect()}
    one = {}
    for k, t in enumerate(sets):
        one.setdefault(t.tobytes(), k)  # a row for each set, its first
    assert set(got) == set(one.values())
    members, parent = sorted(got), {k: k for k in got}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    near, like = [], 0
    for i, a in enumerate(members):
        for b in members[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) < 0.6 * max(len(sets[a]), len(sets[b])):
                continue
            c = simhash.cosine(sets[a], sets[b])
            if c >= 0.8 - 1e-9:
                near.append((a, b))
                parent[top(a)] = top(b)
                common = c * (len(sets[a]) * len(sets[b])) ** 0.5
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                    like += 1
                    assert got[a] == got[b]
    assert like > 50 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    for a in members:
        assert {b for b in members if got[b] == got[a]} <= {b for b in members if top(b) == top(a)}


def test_near_duplicates_with_odd_columns(spark):
    text = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(2, text, 1, 2), (1, text + " more", 3, 4), (None, text, 5, 6), (2, text, 7, 8), (5, "", 9, 9), (5, None, 9, 9)], "doc_id long, TEXT string, d int, H int")
    from rivulet.llm import simhash

    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted((x.doc_id, (x.TEXT or "")[-4:]) for x in got.collect()) == [(1, "more"), (5, "")]


def test_texts_meet_alike_in_inputs_of_all_sizes(spark, monkeypatch):
    """Each text is dealt by the same choices of bits, however many others there are."""
    from pyspark.sql import functions as F

    from rivulet.llm import simhash

    dealt = []
    monkeypatch.setattr(simhash, "links", lambda prints, plans, *_: dealt.append(tuple(plans)) or spark.createDataFrame([], "a long, b long, d int"))
    for n in (10, 140_000):
        text = F.concat_ws(" ", *(F.xxhash64(F.col("id"), F.lit(k)) for k in range(5)))
        simhash.similar(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))).count()
    assert len(dealt) > 1 and dealt[: len(dealt) // 2] == dealt[len(dealt) // 2 :]


def test_large_group_of_near_copies_proposes_few_pairs(spark, monkeypatch):
    """What is one group after the first choices proposes no pair to the others."""
    import random

    from rivulet.llm import common, simhash

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(200)] + [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(200)]
    written = {}

    def cut(df, name="cut"):
        out = common.cut(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    got = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len({x.root for x in got.collect()}) == 1
    assert sum(written["near"]) <= len(texts)
