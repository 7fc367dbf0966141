import corpus_pipeline
import pytest
from gridloom.llm import dedup, quality, suffix, toxicity
from tests.llm.cases import SCHEMA, rows, tokens, words
from tests.llm.test_exact import plain_fingerprint

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    own = tokens(text)
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def near_groups(own):
    """The least id that links of either kind reach, by comparing all pairs."""
    parent = {i: i for i, _ in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, plain_fingerprint(t), shingle_set(t)) for i, t in own]
    for n, (i, f, s) in enumerate(known):
        for j, g, u in known[n + 1 :]:
            if (f ^ g).bit_count() <= 4 or (len(s & u) >= 0.8 * len(s | u)):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in own}


def test_each_stage_does_its_operators_work(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = {n: {r["doc_id"]: r["text"] for r in steps[n](spark, docs, SF).collect()} for n in ("quality", "toxicity", "near_dedup", "passage_dedup")}
    assert set(kept["quality"]) == {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert set(kept["toxicity"]) == {r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
    assert set(kept["near_dedup"]) == set(near_groups([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
    assert kept["passage_dedup"] == {r["doc_id"]: r["kept"] for r in suffix.cut(docs, whole_letters=True).collect() if r["kept"] or not r["n_removed"]}


def test_one_document_of_each_group(spark):
    base = [words(100, k) for k in range(4)]
    chain = [base[0]]
    for k in range(5):  # each near the one before, the ends unlike
        own = chain[-1].split()
        chain.append(" ".join(own[: 16 * k] + words(2, 50 + k).split() + own[16 * k + 2 :]))
    own = [(20 + i, t) for i, t in enumerate(chain)] + [(7, base[1]), (7, base[1] + " end"), (7, base[2]), (9, base[2]), (None, base[3]), (None, base[3]), (None, base[1]), (None, None), (11, ""), (12, " ")]
    found = dedup.one_of_each(spark.createDataFrame([(i, t, "x", "src", k) for k, (i, t) in enumerate(own)], SCHEMA).repartition(5))
    left = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in found.collect())
    want = near_groups([(i, t) for i, t in own if i not in (7, 9, 11, 12, None)])
    assert [x[1] for x in left if not x[0] and x[1] >= 20] == sorted(set(want.values()))
    assert [x for x in left if x[0]] == [(True, None, base[3])]
    assert [x[1] for x in left if not x[0] and x[1] < 20] == [7, 11]


@pytest.mark.parametrize("together", [3, 2048])
def test_mixed_bands_in_blocks(spark, together):
    from gridloom.llm import minhash

    head = words(60, 1)
    texts = [f"{head} {words(n, 100 + k)}" for k, n in enumerate([4, 30, 30, 8, 90, 90, 25, 25, 60, 60])]
    texts += [t + " and" for t in texts[4:8]]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), together=together).collect()}
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if z == y else z for z in label]
    assert found == dict(enumerate(label))


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "passage_dedup", "packing"]


def test_every_stage_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_take_what_the_one_before_leaves(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
