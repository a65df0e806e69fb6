"""Masked pseudo-likelihood scores of documents.

Each token is predicted from the ``REACH`` tokens on either side of it, itself
left out; the document's score is the sum of these conditional log
probabilities.  Tokens are white-space separated forms with A-Z lowered; the
``WORDS`` most frequent of the corpus (counted over all documents) are classes
of their own, other forms share ``OTHERS`` hashed classes.  A token's
probability is that of its class in this context times that of its form within
the class, which comes from the counts of all forms: those of at least one in
``HELD`` tokens go to every task (at most ``HELD`` forms), the others stay a
table and are joined by form, so the vocabulary has no limit and no key of the
join is hot.  A form that was never counted is given the one count that each
hashed class keeps free for such forms.

The class numbers of all documents are written once, a byte a token, to the
shared folder; training and scoring read that table and no text.

The network adds one learned vector per place and class to a hidden layer
(tanh).  Two softmaxes of ``MEMBERS`` each give the class: its group of
classes, which are numbered by falling frequency, then the class in the group.
It is trained in numpy on every token of every document: the rounds take turns
at a document's tokens (``turns``), each token is a target in one of them.  In
a round every task trains a copy of the shared weights on its rows, and the
copies are averaged by a sum per weight, so the driver only ever holds one set
of weights, whatever the input's size.

Edge cases: a null, empty or blank text has no tokens, log_likelihood 0 and
per_token 0; places beyond the ends of a text are a class of their own;
repeated rows count and score as often as they occur; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.llm.common import slices, written

WORDS, OTHERS, REACH, HIDDEN = 192, 64, 2, 48
ROUNDS = 2
CLASSES = WORDS + OTHERS
MEMBERS = 16
GROUPS = CLASSES // MEMBERS
_EDGE = CLASSES
_SLICE_BYTES = 1 << 22
_ROWS = 4096
_HELD_FORMS = 400_000
#: Adam's rate in the first round, by what it falls with each round, and the tokens of a step.
RATE, FALL, BATCH = 1e-2, 5, 2048
#: A form with this share of all tokens, or more, is sent to every task with its count.
HELD = 1 << 17


def _split(texts: pa.Array) -> pa.ListArray:
    low = pc.ascii_lower(texts)
    for white in "\n\t\r":
        low = pc.replace_substring(low, white, " ")
    return pc.split_pattern(low, " ")


def _count_forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def folded() -> pa.Table:
        every = pa.concat_tables(held).group_by("form").aggregate([("n", "sum")])
        return every.select(["form", "n_sum"]).rename_columns(["form", "n"])

    for batch in batches:
        texts = pc.fill_null(batch.column(0), "")
        for i, j in slices(pc.binary_length(texts).to_pylist(), _SLICE_BYTES):
            counts = _split(texts.slice(i, j - i)).flatten().value_counts()
            some = pc.greater(pc.binary_length(counts.field(0)), 0)
            held.append(pa.table({"form": counts.field(0).filter(some), "n": counts.field(1).filter(some)}))
            if sum(map(len, held)) > _HELD_FORMS:
                held = [folded()]
                if len(held[0]) > _HELD_FORMS // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from folded().to_batches()


def form_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(form, n) of every form of all documents."""
    counts = (docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_count_forms, "form string, n long")
              .groupBy("form").agg(F.sum("n").alias("n")))
    return written(counts, "form-counts")


def vocabulary(counts: DataFrame, words: int = WORDS) -> list[tuple[str, int]]:
    """The most frequent forms with their counts."""
    top = counts.orderBy(F.col("n").desc(), "form").limit(words)
    return [(r["form"], r["n"]) for r in top.collect()]  # a bounded number of rows


def class_counts(counts: DataFrame, top: list[tuple[str, int]]) -> np.ndarray:
    """Tokens of each class, counted."""
    out = np.zeros(CLASSES)
    for r in counts.groupBy((F.crc32("form") % OTHERS).alias("c")).agg(F.sum("n").alias("n")).collect():
        out[WORDS + r["c"]] = r["n"]
    for i, (form, n) in enumerate(top):
        out[i] = n
        out[_hashed(form)] -= n
    return out


@dataclass
class Forms:
    """Counts of all forms: the table, the frequent ones, those of the classes; the forms that are classes."""

    counts: DataFrame
    held: dict[str, int]
    of_class: np.ndarray
    words: list[str]

    @classmethod
    def of(cls, counts: DataFrame, held: int = HELD) -> "Forms":
        top = vocabulary(counts)
        of_class = class_counts(counts, top)
        least = max(1, math.ceil(of_class.sum() / held))  # so there are ``held`` such forms at most
        return cls(counts, {r["form"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}, of_class,
                   [w for w, _ in top])


def _hashed(form: str) -> int:
    return WORDS + zlib.crc32(form.encode()) % OTHERS


class Classes:
    """Class number of each token of a batch of texts."""

    def __init__(self, words: list[str]):
        self.known = {w: i for i, w in enumerate(words)}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(classes of all tokens in a row, where each text's tokens start, and the end)."""
        return self.coded(texts)[:2]

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Classes and starts; the distinct forms, their classes, and the number of each token's form among them."""
        split = _split(texts)
        coded = split.flatten().dictionary_encode()
        known = self.known
        of_form = np.array([-1 if not f else known[f] if f in known else _hashed(f)
                            for f in coded.dictionary.to_pylist()], np.int64)
        at = coded.indices.to_numpy().astype(np.int64) if len(coded) else np.zeros(0, np.int64)
        every = of_form[at]
        real = every >= 0
        ends = np.append(0, np.cumsum(real))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return every[real], ends, coded.dictionary, of_form, at[real]


def _softmax(z: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Log probability of the row ``hit`` in each column of ``z``, which becomes the probabilities."""
    z -= z.max(0)
    found = z[hit, np.arange(hit.size)]
    np.exp(z, out=z)
    total = z.sum(0)
    z /= total
    return found - np.log(total)


@dataclass
class Network:
    """``place``: vector per place, class; ``top``: hidden layer to groups; ``inner``: to the classes of each group."""

    place: np.ndarray
    shift: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 11) -> "Network":
        """Small random weights, and the unigram model as the biases."""
        rng = np.random.default_rng(seed)
        share = ((counts + 1) / (counts + 1).sum()).reshape(GROUPS, MEMBERS)
        group = share.sum(1)
        parts = (rng.normal(0, 0.1, (2 * REACH, CLASSES + 1, HIDDEN)), np.zeros(HIDDEN),
                 rng.normal(0, 0.1, (HIDDEN, GROUPS)), np.log(group),
                 rng.normal(0, 0.1, (GROUPS, HIDDEN, MEMBERS)), np.log(share / group[:, None]))
        return cls(*(p.astype(np.float32) for p in parts))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.place, self.shift, self.top, self.top_bias, self.inner, self.inner_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, flat: np.ndarray) -> "Network":
        """A network of this shape with these weights; of float32 ones it holds views."""
        cuts = np.cumsum([p.size for p in self.parts])[:-1]
        return Network(*(c.reshape(p.shape).astype(np.float32, copy=False)
                         for c, p in zip(np.split(flat, cuts), self.parts)))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.place[0].take(context[:, 0], 0)
        for k in range(1, 2 * REACH):
            h += self.place[k].take(context[:, k], 0)
        h += self.shift
        return np.tanh(h, out=h)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(target, kind="stable")
        out = np.empty(target.size)
        out[order] = self.forward(context[order], target[order])[0]
        return out

    def forward(self, context: np.ndarray, target: np.ndarray):
        """Log probabilities, hidden layer, both softmaxes by column, and where each group's rows start.

        ``target`` is sorted, so the rows of a group are neighbours.
        """
        h = self.hidden(context)
        group = target // MEMBERS
        cuts = np.searchsorted(group, np.arange(GROUPS + 1))
        first = self.top.T @ h.T
        first += self.top_bias[:, None]
        second = np.empty((MEMBERS, target.size), np.float32)
        for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                second[:, a:b] = self.inner[g].T @ h[a:b].T + self.inner_bias[g][:, None]
        return _softmax(first, group) + _softmax(second, target % MEMBERS), h, first, second, cuts


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Classes around every token; places outside its text are ``_EDGE``."""
    at = np.arange(tokens.size) + REACH * np.repeat(np.arange(1, starts.size), np.diff(starts))
    spaced = np.full(tokens.size + REACH * starts.size, _EDGE, np.int16)
    spaced[at] = tokens
    return np.stack([spaced[at + d] for d in [*range(-REACH, 0), *range(1, REACH + 1)]], axis=1)


class _Trainer:
    """Adam on the cross-entropy; ``net`` and ``gradient`` are views of one row of numbers each."""

    def __init__(self, net: Network, rate: float = RATE):
        self.rate, self.t = rate, 0
        self.flat = net.flat()
        self.net = net.filled(self.flat)
        self.g, self.m, self.v = (np.zeros_like(self.flat) for _ in range(3))
        self.gradient = net.filled(self.g)

    def slope(self, context: np.ndarray, target: np.ndarray) -> None:
        """Put the gradient of the mean cross-entropy of these tokens into ``gradient``."""
        net, to = self.net, self.gradient
        order = np.argsort(target, kind="stable")
        context, target = context[order], target[order]
        _, h, first, second, cuts = net.forward(context, target)
        rows = np.arange(target.size)
        for z, hit in ((first, target // MEMBERS), (second, target % MEMBERS)):
            z[hit, rows] -= 1
            z *= np.float32(1 / target.size)
        self.g[:] = 0
        to.top[:], to.top_bias[:] = (first @ h).T, first.sum(1)
        dh = first.T @ net.top.T
        for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                part = second[:, a:b]
                to.inner[g], to.inner_bias[g] = (part @ h[a:b]).T, part.sum(1)
                dh[a:b] += part.T @ net.inner[g].T
        dh *= 1 - h * h
        to.shift[:] = dh.sum(0)
        for k in range(2 * REACH):
            order = np.argsort(context[:, k], kind="stable")
            around = context[order, k]
            first_of = np.flatnonzero(np.append(True, around[1:] != around[:-1]))
            to.place[k][around[first_of]] = np.add.reduceat(dh.take(order, 0), first_of, axis=0)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        self.slope(context, target)
        self.t += 1
        self.m += np.float32(0.1) * (self.g - self.m)
        self.v += np.float32(0.001) * (self.g * self.g - self.v)
        size = self.rate * math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        self.flat -= np.float32(size) * self.m / (np.sqrt(self.v) + np.float32(1e-8))


def _form_logs(forms: list[str], classes: np.ndarray, held: dict[str, int], of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log share of each form in its class, whether its count is still missing from that)."""
    n = np.array([held.get(f, 0) for f in forms], np.int64)
    shared = classes >= WORDS
    logs = np.where(shared, np.log(np.maximum(n, 1)) - np.log(of_class[classes] + 1), 0.0)
    return logs, shared & (n == 0)


def class_numbers(docs: DataFrame, words: list[str], id_col: str = "doc_id", text: str = "text",
                  forms: Forms | None = None) -> DataFrame:
    """Written table of every row: row, doc_id, classes (a byte a token), form_logs, rest.

    ``form_logs`` sums the log shares of the forms in their classes (0 without
    ``forms``), ``rest`` lists the forms whose count is still to be joined.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast((words, forms and (forms.held, forms.of_class)))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("classes", T.BinaryType()),
                           T.StructField("form_logs", T.DoubleType()), T.StructField("rest", T.ArrayType(T.StringType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own_forms = sent.value
        classes = Classes(own_words)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slices(pc.binary_length(texts).to_pylist(), _SLICE_BYTES):
                tokens, starts, distinct, of_form, at_form = classes.coded(texts.slice(a, b - a))
                total = np.zeros(b - a)
                rest, cuts = np.zeros(0, np.int64), np.zeros(b - a + 1, np.int64)
                if own_forms and tokens.size:
                    logs, missing = _form_logs(distinct.to_pylist(), of_form, *own_forms)
                    each = np.append(logs[at_form], 0.0)
                    total = np.where(np.diff(starts) > 0, np.add.reduceat(each, starts[:-1]), 0.0)
                    rest = at_form[missing[at_form]]
                    cuts = np.append(0, np.cumsum(missing[at_form]))[starts]
                numbers = pa.Array.from_buffers(pa.binary(), b - a, [
                    None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(tokens.astype(np.uint8))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), numbers, pa.array(total),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), distinct.take(pa.array(rest)).cast(pa.string()))],
                    names=["doc_id", "classes", "form_logs", "rest"])

    # a written row keeps its number, whatever task reads it
    return written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "class-numbers")


def _tokens(numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(class numbers of all rows, where each row's start, and the end)."""
    _, offsets, data = numbers.buffers()
    starts = np.frombuffer(offsets, np.int32)[numbers.offset:numbers.offset + len(numbers) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0]:starts[-1]], starts - starts[0]


def turns(tokens: np.ndarray, starts: np.ndarray, rounds: int) -> np.ndarray:
    """The round that trains on each token: in turn within a text, which starts at a hash of its tokens."""
    n = np.diff(starts)
    total = np.append(0, np.cumsum(tokens, dtype=np.int64))
    mixed = (total[starts[1:]] - total[starts[:-1]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = (mixed >> np.uint64(33)).astype(np.int64)
    return (np.arange(tokens.size) + np.repeat(first - starts[:-1], n)) % rounds


def _trained(numbers: DataFrame, net: Network, rounds: int, batch_rows: int) -> Network:
    """``net`` after all rounds over a table of class numbers."""
    sc = numbers.sparkSession.sparkContext
    for turn in range(rounds):
        sent = sc.broadcast(net.flat())

        def run(batches: Iterable[pa.RecordBatch], turn=turn, sent=sent, shape=net) -> Iterator[pa.RecordBatch]:
            trainer, seen = _Trainer(shape.filled(sent.value), RATE / FALL ** turn), 0
            left = np.zeros((0, 2 * REACH), np.int16), np.zeros(0, np.uint8)
            for batch in batches:
                for i, j in slices(pc.binary_length(batch.column(0)).to_pylist()):
                    tokens, starts = _tokens(batch.column(0).slice(i, j - i))
                    at = np.flatnonzero(turns(tokens, starts, rounds) == turn)
                    context = np.concatenate([left[0], contexts(tokens, starts)[at]])
                    target = np.concatenate([left[1], tokens[at]])
                    whole = len(target) // batch_rows * batch_rows
                    for k in range(0, whole, batch_rows):
                        trainer.step(context[k:k + batch_rows], target[k:k + batch_rows])
                    seen += at.size
                    left = context[whole:], target[whole:]
            if len(left[1]):
                trainer.step(*left)
            if seen:
                w = trainer.flat.astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(w.size, dtype=np.int32)), pa.array(w), pa.array(np.full(w.size, seen))],
                    names=["i", "w", "n"])

        sums = (numbers.select("classes").mapInArrow(run, "i int, w double, n long").groupBy("i")
                .agg((F.sum("w") / F.sum("n")).alias("w")).toPandas())  # one row per weight
        if len(sums):
            flat = net.flat()
            flat[sums["i"].to_numpy()] = sums["w"].to_numpy()
            net = net.filled(flat)
    return net


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, batch_rows: int = BATCH,
          counts: DataFrame | None = None) -> tuple[list[str], Network]:
    """Vocabulary and weights learned from every row of ``docs``; ``counts`` are their ``form_counts``."""
    counts = form_counts(docs, text) if counts is None else counts
    top = vocabulary(counts)
    words = [w for w, _ in top]
    numbers = class_numbers(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), words)
    return words, _trained(numbers, Network.start(class_counts(counts, top)), rounds, batch_rows)


def _scored(numbers: DataFrame, net: Network, counts: DataFrame | None) -> DataFrame:
    """Scores from a table of class numbers; ``counts`` has those of the forms in ``rest``."""
    sent = numbers.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([T.StructField("row", T.LongType()), numbers.schema["doc_id"],
                           T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist()):
                part = batch.slice(a, b - a)
                tokens, starts = _tokens(part.column(2))
                around = contexts(tokens, starts)
                each = np.zeros(tokens.size + 1)
                for i in range(0, tokens.size, _ROWS):
                    each[i:min(i + _ROWS, tokens.size)] = own.log_prob(around[i:i + _ROWS], tokens[i:i + _ROWS])
                n = np.diff(starts)
                total = np.where(n > 0, np.add.reduceat(each, starts[:-1]), 0.0) + part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(total)],
                                                 names=["row", "doc_id", "n_tokens", "log_likelihood"])

    scored = numbers.select("row", "doc_id", "classes", "form_logs").mapInArrow(run, schema)
    if counts is not None:
        more = (numbers.select("row", F.explode("rest").alias("form")).join(counts, "form")
                .groupBy("row").agg(F.sum(F.log("n")).alias("more")))
        scored = scored.join(more, "row", "left").withColumn(
            "log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_likelihood",
                         (F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1))).alias("per_token"))


def score(docs: DataFrame, words: list[str], net: Network, id_col: str = "doc_id", text: str = "text",
          forms: Forms | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token of every row; without ``forms`` that of the classes alone."""
    return _scored(class_numbers(docs, words, id_col, text, forms), net, forms and forms.counts)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` scored by a network and form counts learned from all of them."""
    forms = Forms.of(form_counts(docs))
    numbers = class_numbers(docs, forms.words, forms=forms)
    net = _trained(numbers, Network.start(forms.of_class), ROUNDS, BATCH)
    return _scored(numbers, net, forms.counts)
