"""Languages of documents and of their paragraphs, by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.session import cut

#: Bytes of a window, values of a byte, widths of the filters and filters of each width.
WINDOW, EMBEDDING, WIDTHS, FILTERS = 128, 8, (2, 3, 4, 5), 32
#: Passes over the training windows, windows of a step, step size, share of the label given to all classes, and seed.
EPOCHS, BATCH, RATE, SMOOTHING, SEED = 6, 64, 4e-3, 0.05, 11
#: Fewest steps, however few the windows (then there are more passes), and the shortest crop of a window in training.
LEAST_STEPS, SHORTEST_CROP = 400, 16
#: Labelled documents of a language, and windows of a document, in the training sample: the bounds of what the driver gets.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
#: Windows of one forward pass.
FORWARD = 32
#: Evidence (log odds against the main language, in whole windows) from which on a paragraph makes another language one of its document's.
#: Measured over seeds: paragraphs of other languages have 1.6 and more, those that the network takes wrongly below 0.9.
EVIDENCE = 1.2
#: Parts a text's paragraphs are put apart by while it is cleaned (a control character; the texts' own are removed before).
BREAK = "\x01"
#: Usual notations of the languages besides their two-letter codes (fixed values).
NOTATIONS = {
    "fr": "fra fre french français francais", "en": "eng english anglais", "de": "deu ger german deutsch allemand", "es": "spa spanish español espanol castellano espagnol",
    "it": "ita italian italiano italien", "pt": "por portuguese português portugues portugais", "nl": "nld dut dutch nederlands néerlandais",
}


def label_code(label: Column) -> Column:
    """The two-letter code that a usual notation means, null for none or another."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    table = {n: code for code, names in NOTATIONS.items() for n in (code, *names.split())}
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, plain), F.when(plain.rlike(r"^[a-z]{2,3}[-_][a-z0-9]{2,4}$"), F.try_element_at(codes, F.regexp_extract(plain, r"^([a-z]+)", 1))))


def prose_paragraphs(text: Column) -> Column:
    """The paragraphs of a text, each as the small letters that have a language; null for a null text, ``['']`` for a blank one.

    Paragraphs are the non-blank blocks between lines that are empty or hold only white space. Headings, front matter,
    control tokens, links, names before speech, numbers and dice have no language; a paragraph of nothing else is empty.
    The whole text is cleaned at once, with marks between the paragraphs.
    """
    token = r"<\|[^|<>]*\|>"
    t = F.replace(F.replace(F.replace(text, F.lit(BREAK), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?U)\n(?:[^\S\n]*\n)+", f"\n{BREAK}\n")
    front = rf"^---[^\S\n]*\n[^{BREAK}]*?\n\s*---[^\S\n]*(?=\n|$)"
    t = F.when(t.startswith("---"), F.regexp_replace(t, front, " ")).otherwise(t)
    t = F.regexp_replace(t, rf"(?m)^(?:\s|{token})*(?:#{{1,6}}\s.*$|[^\s:<]{{2,40}}:(?=\s))|{token}|\[\[[^\]]*\]\]", " ")
    t = F.when(t.rlike(r"\d"), F.regexp_replace(t, r"\b\d*+[dD]\d+\b", " ")).otherwise(t)
    return F.split(F.lower(F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}'’{BREAK}]+", " ")), rf" ?{BREAK} ?")


class ByteNetwork:
    """Byte embedding, filters of several widths, the greatest response of each over the window, and a softmax.

    The filters of all widths are one matrix over the widest stretch of bytes, with zeros where a narrower one doesn't reach.
    A byte of zero is padding and has the zero embedding.
    """

    def __init__(self, classes: int, seed: int = SEED) -> None:
        self.rng = np.random.default_rng(seed)
        widest, count = max(WIDTHS), FILTERS * len(WIDTHS)
        scale = np.repeat([(2 / (w * EMBEDDING)) ** 0.5 for w in WIDTHS], FILTERS)
        reach = np.repeat(WIDTHS, FILTERS) * EMBEDDING
        self.mask = (np.arange(widest * EMBEDDING)[:, None] < reach).astype(np.float32)
        weights = {
            "embedding": self.rng.normal(0, 0.5, (256, EMBEDDING)), "filters": self.rng.normal(0, 1, (widest * EMBEDDING, count)) * scale * self.mask, "bias": np.zeros(count),
            "out": self.rng.normal(0, 0.1, (count, classes)), "out_bias": np.zeros(classes),
        }
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.weights["embedding"][0] = 0

    def _stretches(self, x: np.ndarray) -> np.ndarray:
        """The embedded bytes from each position on (windows x positions x values)."""
        widest = max(WIDTHS)
        padded = np.concatenate([x, np.zeros((len(x), widest - 1), np.uint8)], 1)
        flat = self.weights["embedding"][padded].reshape(len(x), -1)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, widest * EMBEDDING, axis=1)[:, ::EMBEDDING])

    def _responses(self, stretches: np.ndarray) -> np.ndarray:
        return (stretches.reshape(-1, stretches.shape[2]) @ self.weights["filters"]).reshape(*stretches.shape[:2], -1)

    def _softmax(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses after the rectifier, and the log-probabilities."""
        hidden = np.maximum(top + self.weights["bias"], 0)
        z = hidden @ self.weights["out"] + self.weights["out_bias"]
        z -= z.max(1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = [self._softmax(self._responses(self._stretches(x[i : i + FORWARD])).max(1))[1] for i in range(0, len(x), FORWARD)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.weights["out_bias"])), np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        stretches = self._stretches(x)
        response = np.matmul(self.weights["filters"].T, stretches.transpose(0, 2, 1))  # positions last: the greatest is found faster
        best = response.argmax(2)
        hidden, logs = self._softmax(response.max(2))
        target = np.full_like(logs, SMOOTHING / logs.shape[1])
        target[np.arange(len(y)), y] += 1 - SMOOTHING
        error = (np.exp(logs) - target) / len(y)
        back = (error @ self.weights["out"].T) * (hidden > 0)
        chosen = stretches[np.arange(len(x))[:, None], best]
        pull = (back[:, :, None] * self.weights["filters"].T).reshape(-1, EMBEDDING)
        padded = np.concatenate([x, np.zeros((len(x), max(WIDTHS) - 1), np.uint8)], 1)
        byte = padded[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))].ravel()
        embedding = np.stack([np.bincount(byte, pull[:, d], 256) for d in range(EMBEDDING)], 1)
        embedding[0] = 0
        return {"embedding": embedding, "filters": np.einsum("bfk,bf->kf", chosen, back, optimize=True) * self.mask, "bias": back.sum(0), "out": hidden.T @ error, "out_bias": error.sum(0)}

    def _cropped(self, x: np.ndarray) -> np.ndarray:
        """Half of the windows whole, of the others a random stretch, so that short paragraphs are seen."""
        length = (x > 0).cumsum(1).max(1)
        wanted = np.where(self.rng.random(len(x)) < 0.5, length, self.rng.integers(SHORTEST_CROP, WINDOW + 1, len(x)))
        wanted = np.minimum(wanted, length)
        begin = (self.rng.random(len(x)) * (length - wanted + 1)).astype(int)
        moved = np.take_along_axis(x, np.minimum(begin[:, None] + np.arange(WINDOW), WINDOW - 1), 1)
        return np.where(np.arange(WINDOW) < wanted[:, None], moved, 0).astype(np.uint8)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam with falling steps; from half-way on, windows whose label isn't what the network finds (wrong labels, paragraphs in another language) are left out.

        A label of which most windows would be left out keeps them all.
        """
        epochs = max(epochs, -(-LEAST_STEPS // max(1, len(x) // BATCH)))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps, use = 0, max(1, epochs * max(1, len(x) // BATCH)), np.arange(len(x))
        for epoch in range(epochs):
            if epoch == epochs // 2:
                agreed = self.log_probabilities(x).argmax(1) == y
                known = np.bincount(y, agreed) >= 0.5 * np.bincount(y)
                use = np.flatnonzero(agreed | ~known[y])
            for part in np.array_split(self.rng.permutation(use), max(1, len(use) // BATCH)):
                if not len(part):
                    continue
                step += 1
                rate = RATE * max(0.03, 1 - step / steps)
                for k, g in self._gradient(self._cropped(x[part]), y[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all bytes of all texts: the text of each, where it begins in the joined bytes, its bytes, and how many of them are new.

    A text has a window for every ``WINDOW`` bytes; the last one ends where the text ends. An empty text has none.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    length = np.diff(at)
    count = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][owner] + np.minimum(number * WINDOW, np.maximum(0, length[owner] - WINDOW))
    size = np.minimum(WINDOW, length[owner])
    new = np.minimum(WINDOW, length[owner] - number * WINDOW)
    return owner, begin, size, new


def window_bytes(texts: pa.Array, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    place = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, data[np.where(inside, place, 0)], 0).astype(np.uint8) if len(data) else np.zeros((len(begin), WINDOW), np.uint8)


def _flat(batch: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The paragraphs of all documents of a batch in one array, and the document of each."""
    lists = batch.column(column)
    if pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.list_(pa.string()))
    texts = pa.concat_arrays([lists.flatten().cast(pa.string())])
    return texts, np.repeat(np.arange(len(lists)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``SAMPLE_WINDOWS`` windows of each document, spread over its text."""
    for batch in batches:
        texts, doc = _flat(batch, "parts")
        owner, begin, size, _ = windows_of(texts)
        long = size >= SHORTEST_CROP
        owner, begin, size = owner[long], begin[long], size[long]
        of = doc[owner]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        total = np.searchsorted(of, of, "right") - np.searchsorted(of, of)
        # the first window of each of SAMPLE_WINDOWS equal shares
        chosen = (total <= SAMPLE_WINDOWS) | (rank * SAMPLE_WINDOWS // np.maximum(total, 1) != (rank - 1) * SAMPLE_WINDOWS // np.maximum(total, 1))
        of, begin, size = of[chosen], begin[chosen], size[chosen]
        found = window_bytes(texts, begin, size)
        yield pa.record_batch([batch.column("key").take(pa.array(of)), batch.column("code").take(pa.array(of)), pa.array(rank[chosen]), pa.array([w.tobytes() for w in found], pa.binary())], names=["key", "code", "i", "window"])


def train_network(docs: DataFrame, codes: list[str], seed: int = SEED) -> ByteNetwork:
    """Trains on at most ``SAMPLE_DOCS`` labelled documents of each language, chosen by a hash of their key, and ``SAMPLE_WINDOWS`` windows of each, spread over the text.

    Windows lie within paragraphs, as those that are classified. The sample and so the network depend on the rows only,
    not on their order or partitioning.
    """
    order = Window.partitionBy("code").orderBy(F.xxhash64("key"), "key")
    labelled = docs.filter(F.col("text").isNotNull()).select("key", label_code(F.col("label")).alias("code")).filter(F.col("code").isin(codes)).distinct()
    keys = labelled.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS).select("key", "code")
    chosen = docs.filter(F.col("text").isNotNull()).select("key", "text").join(F.broadcast(keys), "key").select("key", "code", prose_paragraphs(F.col("text")).alias("parts"))
    sample = chosen.mapInArrow(_sampled, "key long, code string, i long, window binary").toPandas().sort_values(["key", "i", "window"]).drop_duplicates(["key", "code", "i"])
    network = ByteNetwork(len(codes), seed)
    if len(sample):
        x = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
        network.train(x, sample["code"].map({c: i for i, c in enumerate(codes)}).to_numpy())
    return network


def decided(logs: np.ndarray, letters: np.ndarray, doc: np.ndarray, n_docs: int, evidence: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Language of each paragraph, and the main one of each document.

    ``logs`` has the log-probabilities of each paragraph, summed over its windows (a part of a window counts as that part).
    The main language is the one with most letters in paragraphs that it fits best. Another is a language of the document
    if one of its paragraphs speaks for it, against the main one, by ``evidence`` or more; a paragraph gets the best
    language of its document.
    """
    best = logs.argmax(1)
    weight = np.zeros((n_docs, logs.shape[1]))
    np.add.at(weight, (doc, best), letters)
    main = weight.argmax(1)
    odds = logs - np.take_along_axis(logs, main[doc][:, None], 1)
    spoken = np.full((n_docs, logs.shape[1]), -np.inf)
    np.maximum.at(spoken, (doc, best), odds[np.arange(len(best)), best])
    allowed = spoken >= evidence
    allowed[np.arange(n_docs), main] = True
    lang = np.where(allowed[doc], logs, -np.inf).argmax(1)
    weight[:] = 0
    np.add.at(weight, (doc, lang), letters)
    return lang, weight.argmax(1)


def _classified(network: ByteNetwork, codes: list[str]):
    names = pa.array(codes, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, doc = _flat(batch, "parts")
            number = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
            # a paragraph has a language if it holds a word of two letters
            worded = np.flatnonzero(np.asarray(pa.compute.match_substring_regex(texts, r"\pL\pL"), bool))
            texts, doc, number = texts.take(pa.array(worded)), doc[worded], number[worded]
            if not len(texts):
                continue
            letters = np.asarray(pa.compute.utf8_length(pa.compute.replace_substring_regex(texts, r"[ '’]+", ""))).astype(np.int64)
            owner, begin, size, new = windows_of(texts)
            logs = np.zeros((len(texts), len(codes)))
            for i in range(0, len(owner), 64 * FORWARD):
                part = slice(i, i + 64 * FORWARD)
                p = network.log_probabilities(window_bytes(texts, begin[part], size[part]))
                np.add.at(logs, owner[part], p * (new[part, None] / WINDOW))
            lang, main = decided(logs, letters, doc, batch.num_rows)
            odds = np.exp(logs - logs.max(1, keepdims=True))
            sure = odds[np.arange(len(lang)), lang] / odds.sum(1)
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            of = doc[heads]
            spread = np.zeros((batch.num_rows, len(codes)))
            np.add.at(spread, (doc, lang), letters)
            own = np.zeros(batch.num_rows)
            np.add.at(own, doc, np.where(lang == main[doc], letters * sure, 0))
            rows = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(letters), names.take(pa.array(lang)), pa.array(sure)], names=["segment_no", "n_chars", "lang", "confidence"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(doc)].astype(np.int32)), rows)
            main_share = own[of] / spread[of, main[of]]
            here = pa.array(of)
            columns = [batch.column(c).take(here) for c in ("key", "code", "copy")]
            yield pa.record_batch([*columns, names.take(pa.array(main[of])), pa.array(main_share), pa.array((spread[of] > 0).sum(1)), lists], names=["key", "code", "copy", "lang", "confidence", "n_langs", "segments"])

    return run


def identify_languages(docs: DataFrame, codes: list[str], seed: int = SEED) -> DataFrame:
    """``key, code, lang, confidence, n_langs, segments`` of every document with words.

    ``docs`` has ``key`` (long), ``text, label``. ``code`` is the language that the label names (null: none), ``lang`` the
    main language (most letters; ties: first code), ``n_langs`` the number of languages of the document, and ``segments``
    its paragraphs with a language (``segment_no, n_chars, lang, confidence``), numbered from 1 over all non-blank blocks.
    A confidence is the probability that the network gives, weighed by the length of the text: little text, little
    certainty; that of a document is the mean over the letters of its main language.

    Null, empty and wordless texts have no row; whole texts of any length are read. Rows repeated under one key count
    once; of different texts or labels under one key the one with the smallest hash counts. Empty tables give no rows;
    other columns are ignored. A document is decided where it lies: nothing is shuffled but the results.
    """
    network = train_network(docs, codes, seed)
    parts = docs.filter("key is not null and text is not null").select("key", label_code(F.col("label")).alias("code"), F.xxhash64("text", "label").alias("copy"), prose_paragraphs(F.col("text")).alias("parts"))
    segment = "struct<segment_no: int, n_chars: long, lang: string, confidence: double>"
    found = parts.mapInArrow(_classified(network, codes), f"key long, code string, copy long, lang string, confidence double, n_langs long, segments array<{segment}>")
    once = found.groupBy("key").agg(F.min_by(F.struct("code", "lang", "confidence", "n_langs", "segments"), "copy").alias("x"))
    return cut(once.select("key", "x.*"))
