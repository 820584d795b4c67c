"""Subject areas on a small made corpus whose subjects are known."""

import random

import numpy as np
import pytest

from loomgrid.llm import subjects as p9

WORDS = {"science": "atom proton electron quantum enzyme molecule reactor laser".split(), "law": "court verdict judge statute appeal tribunal plaintiff treaty".split(), "sport": "goal striker league referee tournament sprint medal coach".split()}
COMMON = "the and with from this that have been into over after before under while".split()


def corpus(seed, foreign):
    """(rows, truth): English texts and, of a share of them, texts whose every word has a foreign ending."""
    rng, rows, truth = random.Random(seed), [], {}
    names = list(WORDS)
    for i in range(600):
        other = i < 600 * foreign
        subject = names[i % 3]
        text = rng.choices(WORDS[subject], k=12) + rng.choices(COMMON, k=25)
        rng.shuffle(text)
        rows.append((i, "zz" if other else "en", " ".join(w + "osk" if other else w for w in text)))
        truth[i] = subject
    return rows, truth


def found(spark, rows, truth, rated):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    votes = spark.createDataFrame([(i, truth[i], "r") for i in rated], "doc_id long, subject string, rater string")
    names = spark.createDataFrame([(s, s) for s in WORDS], "subject string, description string")
    return {(r.doc_id, r.subject) for r in p9.subject_areas(docs, votes, names).collect()}


def test_held_out_accuracy_in_a_rare_language(spark):
    """Texts in a language of one twelfth of the documents are found as well as the others; unrated texts count."""
    rows, truth = corpus(1, 1 / 12)
    got = found(spark, rows, truth, range(0, 600, 7))
    for ids in (range(50), range(50, 600)):
        held = [i for i in ids if i % 7]
        right = sum((i, truth[i]) in got for i in held)
        assert right / len(held) > 0.9 and sum(d in held for d, _ in got) <= 1.1 * len(held)


def test_texts_about_nothing(spark):
    rows, truth = corpus(2, 0.0)
    nothing = [(1000, "en", None), (1001, "en", ""), (1002, None, " ".join(COMMON * 3)), (1003, "en", "#REDIRECT [[court judge statute]]"), (1004, "en", "{{}} 123 ***")]
    got = found(spark, rows + nothing, truth, range(0, 600, 7))
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003, 1004} and len(got) > 500


@pytest.mark.parametrize("rows, rated", [([], []), ([(1, "en", "court judge")], [])])
def test_nothing_to_go_by(spark, rows, rated):
    assert found(spark, rows, {1: "law"}, rated) == set()


def test_words():
    assert p9.words("Élan VITAL naïve") == ["elan", "vital", "naive"]
    assert p9.words("cafÃ©s ab") == ["cafes"]
    assert p9.words("中文字 abc") == ["abc", "中文", "文字"] and p9.words("字") == ["字"]


def test_products_go_through_used_columns():
    """Dense products of a block equal those of the whole matrix."""
    rng = np.random.default_rng(0)
    idx, count, starts = np.array([7, 2, 7, 30], np.int32), np.array([1, 2, 3, 4]), np.array([0, 2, 2])
    r = p9._Rows(np.arange(3), np.zeros(3, int), idx, count, starts)
    whole = np.zeros((3, 40))
    whole[[0, 0, 2, 2], idx] = [1.0, 2.0, 3.0, 4.0]
    x, axes = r.dense(np.array([1.0, 2.0, 3.0, 4.0])), rng.normal(size=(40, 5))
    assert np.allclose(x @ axes[r.columns], whole @ axes, atol=1e-5)
    assert np.allclose(r.back(x, x @ axes[r.columns], 40), whole.T @ (whole @ axes), atol=1e-4)
