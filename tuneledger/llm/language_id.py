"""Language identification by a bidirectional gated recurrent network over the bytes of a text.

Two small gated recurrent layers read spans of bytes, one from either end, and a softmax over both their states labels
every byte with a language. A document's probabilities are the means of those of all its bytes; the largest one is
its language. The gates use softsign, x / (1 + |x|), in the place of tanh and the logistic function, since it costs
a tenth; training knows this, so nothing is approximated.

- Prediction reads whole texts: they are cut into spans of 64 bytes, the last one filled up with a padding symbol that
  the network knows, and thousands of spans go through the network side by side, so a long text is many spans and not
  a long wait. Numbers of padding are left out of the means.
- Training is backpropagation through time in numpy, in one task, on a bounded sample: at most ``per_language`` distinct
  texts of each of the ``languages`` most frequent languages, one window of at most ``window`` characters of each, from
  anywhere in the text. Texts are chosen by their hash, so copies count once and the sample does not depend on the
  partitions. The model is a few thousand numbers and reaches the tasks by value.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; if nothing was learned all texts are;
with one learned language every text with a letter is in it, with score 1; ties go to the more frequent language, then
the name; a null id counts as an empty text when rows are held out; rows of one id are judged one by one; an empty
table yields no row; columns other than id, text and language are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Answer for texts without a letter.
UNKNOWN = "und"
#: Bytes of a span, units of each direction, spans that go through the network side by side, bytes of text at once.
SPAN, UNITS, SIDE_BY_SIDE, _PIECE = 64, 8, 2_048, 4 << 20
#: The bounds of the training sample.
LANGUAGES, PER_LANGUAGE, WINDOW = 64, 400, 1_024
#: Steps, spans of a step, and the first step's size.
STEPS, BATCH, RATE, SEED = 500, 128, 0.02, 11

#: The symbol behind the end of a text.
_PAD = 256
_FOLDED = np.arange(256, dtype=np.int16)
_FOLDED[ord("A"):ord("Z") + 1] += 32


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(s: np.ndarray) -> np.ndarray:
    """Derivative of softsign, from its value."""
    return (1 - np.abs(s)) ** 2


def spans_of(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spans as rows of symbols, spans per text) of texts whose bytes lie one behind the other."""
    per_text = -(-lengths // SPAN)
    first = np.cumsum(per_text) - per_text
    begin = np.cumsum(lengths) - lengths
    symbols = np.full(int(per_text.sum()) * SPAN, _PAD, np.int16)
    symbols[np.arange(len(data)) + np.repeat(first * SPAN - begin, lengths)] = _FOLDED[data]
    return symbols.reshape(-1, SPAN), per_text


@dataclass
class Layer:
    """One direction: input weights by symbol, recurrent weights, and the bias inside the reset gate's product."""

    inputs: np.ndarray   # 3 units x 257: update gate, reset gate, candidate
    states: np.ndarray   # 3 units x units
    bias: np.ndarray     # units x 1

    def run(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        """States after each row of symbols; the array is reused by the next step."""
        units, width = self.states.shape[1], symbols.shape[1]
        state = np.zeros((units, width), np.float32)
        put, fed, size, gap = (np.empty((3 * units, width), np.float32) for _ in range(4))
        gates = slice(0, 2 * units)
        last = slice(2 * units, 3 * units)
        for row in symbols:
            np.take(self.inputs, row, axis=1, out=put, mode="clip")
            np.matmul(self.states, state, out=fed)
            fed[last] += self.bias
            put[gates] += fed[gates]
            np.abs(put[gates], out=size[gates])
            size[gates] += 1
            put[gates] /= size[gates]
            put[gates] *= 0.5
            put[gates] += 0.5
            fed[last] *= put[units:2 * units]
            put[last] += fed[last]
            np.abs(put[last], out=size[last])
            size[last] += 1
            put[last] /= size[last]
            np.subtract(state, put[last], out=gap[:units])
            gap[:units] *= put[:units]
            np.add(put[last], gap[:units], out=state)
            yield state

    def forward(self, symbols: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """All states, and what the way back needs of each step."""
        units = self.states.shape[1]
        state = np.zeros((units, symbols.shape[1]), self.states.dtype)
        states, kept = [], []
        for row in symbols:
            put, fed = self.inputs[:, row], self.states @ state
            inner = fed[2 * units:] + self.bias
            gates = _softsign(put[:2 * units] + fed[:2 * units])
            update, reset = 0.5 + 0.5 * gates[:units], 0.5 + 0.5 * gates[units:]
            candidate = _softsign(put[2 * units:] + reset * inner)
            kept.append((state, gates, update, reset, inner, candidate))
            state = candidate + update * (state - candidate)
            states.append(state)
        return np.stack(states), kept

    def backward(self, symbols: np.ndarray, kept: list[tuple], pushed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the three arrays from those of all states."""
        units, steps = self.states.shape[1], len(symbols)
        by_input = np.empty((steps, 3 * units, symbols.shape[1]), self.states.dtype)
        by_state, by_bias = np.zeros_like(self.states), np.zeros_like(self.bias)
        flow = np.zeros_like(pushed[0])
        for k in range(steps - 1, -1, -1):
            before, gates, update, reset, inner, candidate = kept[k]
            flow = flow + pushed[k]
            to_candidate = flow * (1 - update) * _slope(candidate)
            to_gates = 0.5 * _slope(gates) * np.concatenate([flow * (before - candidate), to_candidate * inner])
            to_inner = to_candidate * reset
            by_input[k, :2 * units], by_input[k, 2 * units:] = to_gates, to_candidate
            fed = np.concatenate([to_gates, to_inner])
            by_state += fed @ before.T
            by_bias += to_inner.sum(axis=1, keepdims=True)
            flow = flow * update + self.states.T @ fed
        flat = symbols.ravel()
        by_symbol = np.stack([np.bincount(flat, row.ravel(), _PAD + 1) for row in by_input.transpose(1, 0, 2)])
        return by_symbol.astype(self.states.dtype), by_state, by_bias


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-2, keepdims=True))
    return x / x.sum(axis=-2, keepdims=True)


@dataclass
class Model:
    """Both layers and the label weights; ``names`` are the learned languages, the more frequent first."""

    names: list[str]
    ahead: Layer
    back: Layer
    label: np.ndarray    # languages x (2 units + 1)

    @classmethod
    def fresh(cls, names: list[str], units: int = UNITS, seed: int = SEED, kind: type = np.float32) -> Model:
        draw = np.random.default_rng(seed)

        def layer() -> Layer:
            return Layer(*(a.astype(kind) for a in (
                draw.normal(0, 0.3, (3 * units, _PAD + 1)), draw.normal(0, units ** -0.5, (3 * units, units)), np.zeros((units, 1)))))

        return cls(names, layer(), layer(), draw.normal(0, 0.3, (len(names), 2 * units + 1)).astype(kind))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.states, self.ahead.bias, self.back.inputs, self.back.states, self.back.bias, self.label]

    def gradients(self, spans: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of all labelled bytes of some spans, and the gradients of all weights."""
        symbols = np.ascontiguousarray(spans.T)
        units, real = self.ahead.states.shape[1], symbols != _PAD
        one, kept_one = self.ahead.forward(symbols)
        two, kept_two = self.back.forward(symbols[::-1])
        both = np.concatenate([one, two[::-1], np.ones_like(one[:, :1])], axis=1)
        chance = _softmax(self.label @ both)
        n = max(1, int(real.sum()))
        right = chance[:, truth, np.arange(len(truth))]
        loss = -float((np.log(np.maximum(right, 1e-12)) * real).sum()) / n
        chance[:, truth, np.arange(len(truth))] -= 1
        chance *= (real / n)[:, None, :].astype(chance.dtype)
        by_label = np.einsum("tlb,tub->lu", chance, both)
        pushed = self.label.T @ chance
        return loss, [*self.ahead.backward(symbols, kept_one, pushed[:, :units]),
                      *self.back.backward(symbols[::-1], kept_two, pushed[::-1, units:2 * units]), by_label]

    def labels(self, spans: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each span of the probabilities of all languages: one row per span."""
        units, found = self.ahead.states.shape[1], np.zeros((len(spans), len(self.names)))
        left, right, bias = self.label[:, :units], self.label[:, units:2 * units], self.label[:, 2 * units:]
        for at in range(0, len(spans), SIDE_BY_SIDE):
            symbols = np.ascontiguousarray(spans[at:at + SIDE_BY_SIDE].T.astype(np.intp))
            scores = np.empty((SPAN, len(self.names), symbols.shape[1]), np.float32)
            for k, state in enumerate(self.ahead.run(symbols)):
                np.matmul(left, state, out=scores[k])
            total = np.zeros(scores.shape[1:], np.float32)
            for k, state in zip(range(SPAN - 1, -1, -1), self.back.run(symbols[::-1])):
                now = scores[k]
                now += right @ state
                now += bias
                now -= now.max(axis=0)
                np.exp(now, out=now)
                now *= (symbols[k] != _PAD) / now.sum(axis=0)
                total += now
            found[at:at + SIDE_BY_SIDE] = total.T
        return found

    def pooled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean probabilities of the languages over all bytes of each text."""
        spans, per_text = spans_of(data, lengths)
        sums = np.zeros((len(lengths) + 1, len(self.names)))
        np.add.at(sums, np.repeat(np.arange(len(lengths)), per_text), self.labels(spans))
        return sums[:-1] / np.maximum(lengths, 1)[:, None]

    def positions(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        spans, _ = spans_of(np.frombuffer(data := text.encode(), np.uint8), np.array([len(data)]))
        symbols = spans.T
        both = np.concatenate([self.ahead.forward(symbols)[0], self.back.forward(symbols[::-1])[0][::-1]], axis=1)
        units = 2 * self.ahead.states.shape[1]
        best = (self.label[:, :units] @ both + self.label[:, units:]).argmax(axis=1)
        return [self.names[k] for k in best.T.ravel()[:len(data)]]

    @classmethod
    def from_bytes(cls, data: bytes, names: list[str]) -> Model:
        with np.load(io.BytesIO(data)) as held:
            w = [held[f"arr_{k}"] for k in range(7)]
        return cls(names, Layer(*w[:3]), Layer(*w[3:6]), w[6])


def train(spans: np.ndarray, truth: np.ndarray, names: list[str], steps: int = STEPS, batch: int = BATCH,
          rate: float = RATE, seed: int = SEED) -> Model:
    """A model from spans and their languages' numbers: Adam with a step size that falls to zero along a half cosine.

    Each span of a step is drawn from a language that is drawn first, so a rare language is learned like a frequent one.
    """
    model, draw = Model.fresh(names, seed=seed), np.random.default_rng(seed)
    weights = model.weights()
    mean, power = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = np.argsort(truth, kind="stable")
    sizes = np.bincount(truth, minlength=len(names))
    starts, drawn = np.cumsum(sizes) - sizes, np.flatnonzero(sizes)
    for step in range(steps):
        name = draw.choice(drawn, batch)
        chosen = order[starts[name] + (draw.random(batch) * sizes[name]).astype(np.int64)]
        _, slopes = model.gradients(spans[chosen], truth[chosen])
        size = min(1.0, 5 / max(1e-12, float(np.sqrt(sum((g * g).sum() for g in slopes)))))
        pace = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
        for w, m, p, g in zip(weights, mean, power, slopes):
            m += 0.1 * (g * size - m)
            p += 0.01 * ((g * size) ** 2 - p)
            w -= (pace * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(p / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(w.dtype)
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows that may not be learned from, by the checksum of their id."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(rows: DataFrame, text: str = "text", lang: str = "lang", languages: int = LANGUAGES,
           per_language: int = PER_LANGUAGE, window: int = WINDOW) -> tuple[list[str], DataFrame]:
    """(languages, the more frequent first; their sample as (name, hash, part)) of labelled rows.

    Texts are thinned by their hash to about twice the sample before any is ranked, so no language meets in one task.
    """
    known = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("name"), F.col(text).cast("string").alias("whole")).withColumn("hash", F.xxhash64("whole"))
    counts = known.groupBy("name").agg(F.approx_count_distinct("hash").alias("n")).orderBy(F.desc("n"), "name").limit(languages)
    found = [(row["name"], row["n"]) for row in counts.collect()]
    if not found:
        return [], known.select("name", "hash", F.lit("").alias("part")).limit(0)
    kept = F.create_map(*[F.lit(x) for name, n in found for x in (name, min(1.0, 2.0 * per_language / max(1, n)))])
    lot = F.pmod("hash", F.lit(1 << 30)) / F.lit(1 << 30)
    start = 1 + F.pmod(F.shiftright("hash", 30), F.greatest(F.lit(1), F.length("whole") - window))
    chosen = known.where(lot < F.element_at(kept, F.col("name"))).select(
        "name", "hash", F.substring("whole", start.cast("int"), F.lit(window)).alias("part"))
    single = chosen.groupBy("name", "hash").agg(F.min("part").alias("part"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("hash"))
    return [name for name, _ in found], single.withColumn("place", place).where(F.col("place") <= per_language).drop("place")


def fit(spark: SparkSession, rows: DataFrame, fresh_dir: Callable[[SparkSession, str], str], text: str = "text",
        lang: str = "lang", **bounds: int) -> Model | None:
    """The model of labelled rows, trained in one task on their sample; None if there are none."""
    names, chosen = sample(rows, text, lang, **bounds)
    if not names:
        return None
    folder = fresh_dir(spark, "language-sample")
    chosen.write.parquet(folder)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        data = [part.encode() for _, _, part in held]
        spans, per_text = spans_of(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64))
        truth = np.repeat(np.array([names.index(name) for name, _, _ in held], np.int64), per_text)
        model = train(spans, truth, names)
        out = io.BytesIO()
        np.savez(out, *model.weights())
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    stored = fresh_dir(spark, "language-model")
    spark.read.parquet(folder).coalesce(1).mapInArrow(learn, "model binary").write.parquet(stored)
    return Model.from_bytes(bytes(spark.read.parquet(stored).first()["model"]), names)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language and its mean probability of every text."""
    chosen = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"),
                         F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return chosen.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.names, UNKNOWN], object)
        for batch in batches:
            texts, lettered = batch.column(2).cast(pa.large_string()).fill_null(""), batch.column(3).to_numpy(zero_copy_only=False)
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            chance, row = np.zeros((len(texts), len(model.names))), 0
            while row < len(texts):
                stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _PIECE, "right")) - 1)
                chance[row:stop] = model.pooled(data[ends[row]:ends[stop]], np.diff(ends[row:stop + 1]))
                row = stop
            best = chance.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
            score = np.where(lettered, np.clip(chance.max(axis=1, initial=0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[np.where(lettered, best, len(model.names))].tolist(), pa.string()),
                 pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
