import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from indicata.llm import pseudo_likelihood as P
from indicata.llm.common import table


def brute(net, classes):
    total = 0.0
    for i, target in enumerate(classes):
        around = [classes[j] if 0 <= j < len(classes) else P._EDGE
                  for j in [*range(i - P.REACH, i), *range(i + 1, i + P.REACH + 1)]]
        h = np.tanh(net.shift + sum(net.place[k][c] for k, c in enumerate(around)))
        g, member = divmod(int(target), P.MEMBERS)
        for z, hit in ((h @ net.top + net.top_bias, g), (h @ net.inner[g] + net.inner_bias[g], member)):
            z = z.astype(float)
            total += z[hit] - math.log(np.exp(z - z.max()).sum()) - z.max()
    return total


def test_scores_are_the_brute_force_sums(spark, odd_docs):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id between 100 and 129").unionByName(
        odd_docs.where("doc_id <> 5").drop("Lang_Pred"))
    words, net = P.train(docs)
    rng = np.random.default_rng(0)
    net = net.filled(net.flat() + rng.normal(0, 0.3, net.flat().size))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    number = P.Classes(words)
    for r in P.score(docs, words, net).collect():
        tokens, starts = number(pa.array([text[r["doc_id"]]]))
        assert r["n_tokens"] == len(tokens) == starts[1] == len([w for w in text[r["doc_id"]].replace("\n", " ").replace("\t", " ").split(" ") if w])
        assert abs(r["log_likelihood"] - brute(net, tokens.tolist())) < 1e-3 * (1 + len(tokens))


def test_gradient_steps_follow_the_loss():
    rng = np.random.default_rng(1)
    tokens = np.tile([3, 7, 9, 11], 600)
    starts = np.array([0, len(tokens)])
    net = P.Network.start(np.ones(P.CLASSES))
    at = np.arange(len(tokens))
    context = P.contexts(tokens, starts)
    before = net.log_prob(context, tokens).mean()
    trainer = P._Trainer(net)
    for _ in range(60):
        pick = rng.choice(at, 256)
        trainer.step(context[pick], tokens[pick])
    assert before < -5 and trainer.net.log_prob(context, tokens).mean() > -0.3


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, P.CLASSES, 60).astype(np.uint8)
    starts = np.array([0, 20, 20, 23, 60])
    context = P.contexts(tokens, starts)
    net = P.Network.start(rng.integers(0, 50, P.CLASSES))
    net = net.filled(net.flat() + rng.normal(0, 0.4, net.flat().size).astype(np.float32))
    trainer = P._Trainer(net)
    trainer.slope(context, tokens)
    flat, slope = net.flat().astype(float), trainer.g

    def loss(weights):
        # the plain definition in doubles, one token at a time
        place, shift, top, top_bias, inner, inner_bias = (
            c.reshape(p.shape) for c, p in zip(np.split(weights, np.cumsum([p.size for p in net.parts])[:-1]), net.parts))
        total = 0.0
        for around, t in zip(context, tokens.tolist()):
            h = np.tanh(shift + sum(place[k][c] for k, c in enumerate(around)))
            g, member = divmod(t, P.MEMBERS)
            for z, hit in ((h @ top + top_bias, g), (h @ inner[g] + inner_bias[g], member)):
                total -= z[hit] - math.log(np.exp(z).sum())
        return total / len(tokens)

    parts = np.cumsum([0] + [p.size for p in net.parts])
    used = np.flatnonzero(slope)
    for a, b in zip(parts[:-1], parts[1:]):
        inside = used[(used >= a) & (used < b)]
        for i in [*rng.choice(inside, 8), rng.integers(a, b)]:
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - slope[i]) < 1e-5


def test_contexts_stay_inside_their_text():
    rng = np.random.default_rng(2)
    starts = np.array([0, 0, 1, 3, 3, 9, 9])
    tokens = rng.integers(0, P.CLASSES, 9).astype(np.uint8)
    got = P.contexts(tokens, starts)
    for a, b in zip(starts[:-1], starts[1:]):
        for i in range(a, b):
            assert got[i].tolist() == [tokens[j] if a <= j < b else P._EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
    assert P.contexts(tokens[:0], np.array([0, 0])).shape == (0, 4)


def test_a_round_averages_the_tasks_weights_by_their_tokens(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    words = [w for w, _ in P.vocabulary(P.form_counts(docs))]
    start = P.Network.start(np.ones(P.CLASSES))
    numbers = P.class_numbers(docs, words).repartition(3, "doc_id")
    got = P._trained(numbers, start, 2, 64).flat()
    want = start
    by_task = numbers.withColumn("task", F.spark_partition_id()).toPandas().groupby("task").classes.apply(list)
    for turn in range(2):
        sums, seen = np.zeros(got.size), 0
        for rows in by_task:
            tokens = np.frombuffer(b"".join(rows), np.uint8)
            starts = np.append(0, np.cumsum([len(r) for r in rows]))
            mine = P.turns(tokens, starts, 2) == turn
            context, target = P.contexts(tokens, starts)[mine], tokens[mine]
            trainer = P._Trainer(want, P.RATE / P.FALL ** turn)
            for i in range(0, len(target), 64):
                trainer.step(context[i:i + 64], target[i:i + 64])
            sums, seen = sums + trainer.flat.astype(float) * len(target), seen + len(target)
        want = want.filled((sums / seen).astype(np.float32))
    assert len(by_task) == 3 and np.abs(got - want.flat()).max() < 1e-4


def test_training_beats_unigrams_and_covers_all_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    words, net = P.train(docs)
    counts = {}
    for r in docs.collect():
        for w in r["text"].replace("\n", " ").split(" "):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            if w:
                counts[w] = counts.get(w, 0) + 1
    assert words == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:P.WORDS]]
    plain = P.Network.start(np.array([counts[w] for w in words] + [sum(counts.values()) / 200] * P.OTHERS))
    plain.top[:], plain.inner[:] = 0, 0
    learned, unigram = (P.score(docs, words, n).toPandas().log_likelihood.sum() for n in (net, plain))
    assert learned > unigram


def test_edges(spark, odd_docs, no_docs):
    rows = P.score_corpus(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: r for r in rows}
    for i in (2, 3, 4):
        assert (got[i]["n_tokens"], got[i]["log_likelihood"], got[i]["per_token"]) == (0, 0, 0)
    assert got[5]["n_tokens"] == 150_000 and all(r["log_likelihood"] <= 0 for r in rows)
    assert P.score_corpus(no_docs).count() == 0


def test_forms_of_a_hashed_class_are_told_apart(spark):
    by_class = {}
    for i in range(2000):
        by_class.setdefault(zlib.crc32(f"f{i}".encode()) % P.OTHERS, []).append(f"f{i}")
    often, rare, never = max(by_class.values(), key=len)[:3]
    top = " ".join(f"w{i}" for i in range(P.WORDS)) + " "
    docs = spark.createDataFrame(
        [(0, top * 60), (1, f"{often} " * 50), (2, rare), (3, often), (4, f"w1 {rare} w2 {often}")], "doc_id long, text string")
    counts = P.form_counts(docs)
    words, net = P.train(docs, counts=counts)
    assert often not in words and rare not in words
    # the classes' start is what was counted: one hashed class has 54 tokens, the others none
    shared = P.class_counts(counts, P.vocabulary(counts))[P.WORDS:]
    assert shared.sum() == shared.max() == 54
    new = docs.unionByName(spark.createDataFrame([(5, never)], docs.schema))
    plain = {r["doc_id"]: r for r in P.score(new, words, net).collect()}
    few = P.Forms.of(counts, held=20)  # no form is sent along, all are joined
    assert not few.held and often in P.Forms.of(counts).held
    for forms in (few, P.Forms.of(counts)):
        full = {r["doc_id"]: r for r in P.score(new, words, net, forms=forms).collect()}
        more = {i: full[i]["log_likelihood"] - plain[i]["log_likelihood"] for i in full}
        one, many = math.log(2 / 55), math.log(52 / 55)
        want = {0: 0, 1: 50 * many, 2: one, 3: many, 4: one + many, 5: math.log(1 / 55)}
        assert all(abs(more[i] - want[i]) < 1e-4 for i in want), more


def test_every_token_is_a_target_in_one_round():
    rng = np.random.default_rng(3)
    n = np.array([1, 0, 1, 2, 5, 8, 40, 3])
    starts = np.append(0, np.cumsum(n))
    tokens = rng.integers(0, P.CLASSES, starts[-1])
    turn = P.turns(tokens, starts, P.ROUNDS)
    assert set(turn) == set(range(P.ROUNDS))
    for a, b in zip(starts[:-1], starts[1:]):
        assert np.array_equal(turn[a:b], (turn[a:a + 1] + np.arange(b - a)) % P.ROUNDS)
        assert np.array_equal(turn[a:b], P.turns(tokens[a:b], np.array([0, b - a]), P.ROUNDS))  # whatever the slice
