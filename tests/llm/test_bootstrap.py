"""The bootstrap of op1: long chains, long words, and its scores against a plain loop."""

import collections
import math
import random

from freightaudit.llm import pii


#: Cues have letters only: a word with a digit is a candidate itself and no context.
def lines(*parts):
    """One document an occurrence: (cue, token, times)."""
    return [f"{cue} {token}" for cue, token, times in parts for _ in range(times)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def learned(spark, texts):
    return {t for t, r in zip(texts, sorted(pii.find(frame(spark, texts)).collect(), key=lambda r: r.doc_id)) if r.n_learned}


def test_chains_of_five_patterns_are_followed(spark):
    hops, names = 5, "abcdef"
    texts = lines(*[("cue-a", f"u{i}@x.org", 1) for i in range(200)])
    for hop in range(hops):
        for k in range(3):
            token = f"{names[hop]}{k}77{hop}{k}"
            texts += lines((f"cue-{names[hop]}", token, 1), (f"cue-{names[hop + 1]}", token, 20))
    texts += lines(*[("plain", f"z{i}4444", 1) for i in range(20)])
    found = learned(spark, texts)
    assert found == {t for t in texts if "@" not in t and not t.startswith("plain")}


def test_context_words_are_whole(spark):
    tail = "x" * 80
    texts = lines(*[(f"good{tail}", f"u{i}@x.org", 1) for i in range(20)])
    texts += lines((f"good{tail}", "q12345", 1), (f"other{tail}", "q54321", 1))
    texts.append("u@x.org" + " filler" * 20_000 + f" good{tail} \n q99999")
    assert learned(spark, texts) == {texts[20], texts[22]}


def plain_scores(texts):
    """The same graph and scores by dicts; every text is 'cue token'."""
    totals = collections.Counter(w for t in texts for w in t.lower().split())
    edges = collections.Counter(tuple(t.lower().split()) for t in texts)
    seed = {token: "@" in token for _, token in edges}
    asked = {cue for cue, token in edges if not seed[token]}
    edges = {e: n for e, n in edges.items() if e[0] in asked}
    score = {token: float(seed[token]) for _, token in edges}
    while True:
        confidence = {}
        for cue in asked:
            own = [(n, score[token]) for (c, token), n in edges.items() if c == cue]
            good = sum(n * s for n, s in own)
            enough = sum(s >= pii.CONFIDENCE for _, s in own) >= pii.MIN_SUPPORT
            confidence[cue] = good / totals[cue] if enough else 0.0
        new = {}
        for token in score:
            doubt = sum(math.log(1 - min(confidence[c], 0.9999)) for c, t in edges if t == token)
            new[token] = 1.0 if seed[token] else 1 - math.exp(doubt)
        rise = max((new[t] - score[t] for t in score), default=0.0)
        score = new
        if rise < pii.TOLERANCE:
            return {t: s for t, s in score.items() if not seed[t] and s >= pii.CONFIDENCE}


def test_scores_equal_a_plain_loop(spark):
    draw = random.Random(7)
    texts = []
    for _ in range(600):
        cue = draw.randrange(12)
        seeds = draw.random() < 0.15 + cue / 15
        token = f"u{draw.randrange(90)}@x.org" if seeds else f"t{draw.randrange(60)}999"
        texts.append(f"cue-{chr(97 + cue)} {token}")
    docs = frame(spark, texts)
    got = pii.learned_instances(pii.occurrences(pii.scan(docs)), docs)
    got = {r.token: r.score for r in got.collect()}
    want = plain_scores(texts)
    assert want and got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)
