"""Co-training against the same method in plain loops, and what the views give each other."""

import math
import random
import zlib

import pytest

from tracelake.llm import cotraining as C

GOOD, BAD = ["river", "stone", "garden", "letter", "winter"], ["click", "cheap", "winner", "casino", "bonus"]


def made(seed, n, labelled, strong_meta):
    """Documents whose words and whose source tell their quality more or less well."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [rng.choice(GOOD if (rng.random() < 0.8) == good else BAD) for _ in range(rng.randrange(4, 12))]
        told = good if rng.random() < strong_meta else not good
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), f"{'press' if told else 'spam'}{rng.randrange(2)}", rng.randrange(50, 5000)))
        if i < labelled:
            labels.append((i, int(good)))
    return docs, labels


def plain_scores(docs, labels, rounds, confident, weight):
    """Counting, isotonic blocks and exchange, document by document."""
    label = dict(labels)
    part = {i: C.NO_PART if i not in label else {0: C.CALIBRATE, 1: C.TEST}.get(zlib.crc32(str(i).encode()) % 5, C.TRAIN) for i, *_ in docs}
    feats = {i: (set(C.text_features(t).tolist()), set(C.meta_features(lang, src, n).tolist())) for i, t, lang, src, n in docs}
    given = []

    def fit(pseudo):
        models = []
        for k in (0, 1):
            size, seen = [0.0, 0.0], [{}, {}]
            for i in feats:
                w = [float(part[i] == C.TRAIN and label[i] == c) for c in (0, 1)]
                if i not in label and pseudo:
                    p = pseudo[1 - k][i]
                    w = [w[0] + weight * (p <= 1 - confident), w[1] + weight * (p >= confident)]
                for c in (0, 1):
                    size[c] += w[c]
                    for f in feats[i][k]:
                        seen[c][f] = seen[c].get(f, 0.0) + w[c]
            models.append((size, seen))

        def score(i, k):
            size, seen = models[k]
            total = 0.0
            for lo, hi in C.BLOCKS[k]:
                own = [f for f in feats[i][k] if lo <= f < hi]
                total += sum(math.log((seen[1].get(f, 0.0) + 0.5) / (size[1] + 1)) - math.log((seen[0].get(f, 0.0) + 0.5) / (size[0] + 1)) for f in own) / max(1, len(own))
            return min(max(total, -4.0), 4.0)

        chances = []
        for k in (0, 1):
            binned = {i: min(int((score(i, k) + 4.0) / 8.0 * 200), 199) for i in feats}
            by_bin: dict = {}
            for i in feats:
                if part[i] == C.CALIBRATE:
                    by_bin.setdefault(binned[i], []).append(label[i])
            # pool neighbours until the shares rise
            blocks = [[sum(v), len(v), b] for b, v in sorted(by_bin.items())]
            j = 0
            while j + 1 < len(blocks):
                if blocks[j][0] / blocks[j][1] >= blocks[j + 1][0] / blocks[j + 1][1]:
                    blocks[j] = [blocks[j][0] + blocks[j + 1][0], blocks[j][1] + blocks[j + 1][1], blocks[j][2]]
                    del blocks[j + 1]
                    j = max(0, j - 1)
                else:
                    j += 1
            chances.append({i: next((g + 0.5) / (m + 1) for n, (g, m, b) in reversed(list(enumerate(blocks))) if n == 0 or binned[i] >= b) for i in feats})
        return models, chances

    models, chances = fit(None)
    base = [sum(m) for m in models[0][:1]]
    for r in range(rounds):
        models, chances = fit(chances)
        given += [(r + 1, name, *[round((models[k][0][c] - sum(part[i] == C.TRAIN and label.get(i) == c for i in feats)) / weight) for c in (0, 1)]) for k, name in enumerate(("text", "meta"))]
    train = [label[i] for i in feats if part[i] == C.TRAIN]
    prior = min(max(sum(train) / len(train), 1e-3), 1 - 1e-3)
    logit = lambda p: math.log(p) - math.log1p(-p)
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    del base
    return {i: 1 / (1 + math.exp(-(sum(logit(clip(c[i])) for c in chances) - logit(prior)))) for i in feats}, given


@pytest.mark.parametrize(("seed", "rounds", "confident"), [(1, 0, 0.95), (2, 2, 0.8), (3, 3, 0.7)])
def test_scores_by_hand(spark, seed, rounds, confident):
    docs, labels = made(seed, 260, 120, 0.85)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    want, given = plain_scores(docs, labels, rounds, confident, 0.5)
    got = {r["doc_id"]: r["score"] for r in C.quality_scores(frame, told, rounds=rounds, confident=confident).collect()}
    assert len(got) == len(want) and all(abs(got[i] - want[i]) < 1e-4 for i in want)
    if rounds:
        views, exchanged = C.co_train(C.features(frame, told), rounds, confident)
        assert exchanged == given and len(views) == 2


def test_both_views_give_labels(spark):
    """With few labels and two views that tell much, each labels documents for the other."""
    docs, labels = made(5, 600, 90, 0.97)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    _, told = C.co_train(C.features(frame, spark.createDataFrame(labels, "doc_id long, quality int")), 1, 0.85)
    assert {name for _, name, bad, good in told if bad + good > 20} == {"text", "meta"}
