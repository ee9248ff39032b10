"""The stages in order, on a few documents with planted cases."""

import random

import corpus_pipeline


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_stages(spark):
    rng = random.Random(12)
    vocab = {"en": "the of and to house water great reading thing with other from".split(), "de": "der und das haus wasser nicht schön mit einer lesen von anderen".split()}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "s", "er"]) for _ in range(n))
    data = [(i, prose(lang, 80), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 30)]
    base = prose("en", 120).split()
    near = list(base)
    near[60] = "changed"
    passage = prose("en", 70)
    data += [(100, " ".join(base), "en", "s", 0), (101, " ".join(near), "en", "s", 0), (102, " ".join(base), "en", "s", 0)]
    data += [(110, prose("en", 60) + passage + prose("en", 60), "en", "s", 0), (111, prose("en", 50) + passage + prose("en", 40), "en", "s", 0)]
    data += [(120, "1234 5678 --- ###", "en", "s", 0), (121, None, "en", "s", None), (122, "", None, None, 0), (123, prose("en", 60) + " mail a.b@c.example now", "en", "s", 0)]
    junk = "".join(rng.choice("qxzjkwvyüß") for _ in range(400))
    data += [(124, " ".join(junk[k : k + 7] for k in range(0, 400, 7)), None, "s", 0), (125, "ሰላም ለዓለም ይህ ጽሑፍ ነው " * 20, None, "s", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {120, 121, 122, 124, 125}.isdisjoint(kept["language_id"]) and len(kept["language_id"]) == len(data) - 5
    assert set(kept["language_id"]) - set(kept["near_dedup"]) == {101, 102}
    assert all(passage not in t for t in kept["suffix_dedup"].values()) and kept["suffix_dedup"][0] == data[0][1]
    assert kept["pii"][123].endswith("mail [EMAIL] now") and kept["pii"][5] == data[5][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(kept["pii"])
