"""BLEU with 13a tokens and smoothing, and ROUGE over stems, against hand-worked values."""

import math

import pytest
from pyspark.sql import functions as F

from trustframe.functions.stem import porter_stem
from trustframe.operators.text import (bleu_tokens_13a, corpus_bleu_smoothed, rouge_l, rouge_n, rouge_tokens_stemmed)

K = ["k"]


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"),
    ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"),
    ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
    ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"),
    ("digitizer", "digit"), ("radicalli", "radic"), ("differentli", "differ"), ("vietnamization", "vietnam"),
    ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"),
    ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"),
    ("electriciti", "electr"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"),
    ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("irritant", "irrit"),
    ("replacement", "replac"), ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"), ("homologou", "homolog"),
    ("communism", "commun"), ("activate", "activ"), ("effective", "effect"), ("bowdlerize", "bowdler"), ("probate", "probat"),
    ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("", "")])
def test_published_stems(word, stem):
    assert porter_stem(word) == stem


def test_13a_tokens(spark):
    texts = ["Hello, world!", "It costs 1,000.50 dollars.", "a-b 3-4", "x &quot;y&quot; &amp; z", "line-\nbreak\nnext", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in df.select("i", bleu_tokens_13a(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [["Hello", ",", "world", "!"], ["It", "costs", "1,000.50", "dollars", "."], ["a-b", "3", "-", "4"],
                   ["x", '"', "y", '"', "&", "z"], ["linebreak", "next"], [], None]


def _bleu(spark, pairs):
    return corpus_bleu_smoothed(spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)],
                                                      "k int, prediction string, reference string"), K).first()


def test_smoothed_bleu(spark):
    assert _bleu(spark, [("the cat sat on the mat", "the cat sat on the mat")]).bleu_score == pytest.approx(100.0)
    # 4 of 6 words, 1 of 5 pairs, no triple (1/2 of 4) and no quadruple (1/4 of 3)
    got = _bleu(spark, [("the cat is on a mat", "the cat sat under the mat on")])
    logs = math.log(4 / 6) + math.log(1 / 5) + math.log(0.5 / 4) + math.log(0.25 / 3)
    assert got.bleu_score == pytest.approx(100 * math.exp(1 - 7 / 6) * math.exp(logs / 4))
    assert _bleu(spark, [("a b c d", "e f g h")]).bleu_score == 0.0
    assert _bleu(spark, [("a b", "a b")]).bleu_score == 0.0
    assert _bleu(spark, []).bleu_score == 0.0


def test_stemmed_rouge(spark):
    df = spark.createDataFrame([(1, "The runners were running quickly", "a runner runs quick"), (2, "", "x")],
                               "k int, prediction string, reference string")
    # stems: the runner were run quickli / a runner runs->run quick
    n, one = rouge_n(df, K, rouge_tokens_stemmed).first(), 2 * (2 / 5) * (2 / 4) / (2 / 5 + 2 / 4)
    assert n.rouge1 == pytest.approx(one / 2) and n.rouge2 == 0.0
    assert rouge_l(df, K, rouge_tokens_stemmed).first().rougeL == pytest.approx(one / 2)


def test_tokens_of_a_batch_are_numbers_of_its_distinct_ones(spark, monkeypatch):
    import pyarrow as pa

    from trustframe.functions import stem
    from trustframe.operators.text import _coded
    words = pa.array([["relational", "the", "relational"], None, [], ["cats", None, "relational"]] * 500).slice(1)
    seen = []
    monkeypatch.setattr(stem, "porter_stem", lambda w: seen.append(w) or w[:3])
    got = stem.stem_tokens.func(words).to_pylist()
    assert got[:4] == [None, [], ["cat", None, "rel"], ["rel", "the", "rel"]] and sorted(seen) == ["cats", "relational"]
    pairs = [(x.tolist(), y.tolist()) for x, y in _coded(words.slice(0, 3), words.slice(1, 3))]
    assert pairs[0] == ([], []) and pairs[1][0] == [] and len(pairs[2][0]) == len(pairs[2][1]) == 3
    assert pairs[2][0][2] == pairs[2][1][0] == pairs[2][1][2] != pairs[2][1][1]
