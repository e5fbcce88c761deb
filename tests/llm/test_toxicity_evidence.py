"""What the voters see, whatever the length of the text."""

import numpy as np

from guidemill.llm.toxicity import VOTERS, evidence, votes


def cast(text, mined=None):
    return dict(zip(VOTERS, votes(np.array([evidence(text, mined or {})]))[0].tolist()))


def test_a_passage_votes_alike_in_a_long_text():
    filler, passage = "plain words of a report " * 4000, "what an idiot , worthless blurgon"
    short, long = cast(passage, {"blur": 0}), cast(filler + passage + " " + filler, {"blur": 0})
    assert short == long and all(short[v] == 1 for v in ("intellect", "worth", "mined_0", "several")) and not short["no_word"]
    far = cast("idiot " + filler + " worthless")
    assert far["intellect"] == far["worth"] == 1 and far["several"] == 0
