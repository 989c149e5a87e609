"""Language-model scores of documents: word counts as a base, and a self-attention model over subwords.

Counts are taken over all training documents by Spark. The most frequent words,
a fixed number of them, go to every task; the words of a document that are not
among them are looked up by a join. Texts are encoded once, into a table from which
the model learns and scores. The attention model is trained in parallel:
each training document is cut into consecutive windows, so that every token is a
target once. The documents come in rounds, each with a larger share of them; in a
round each task trains on its part of the windows from common parameters, and the
results are averaged before the next.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmesh.functions.storage import discard

from . import attention, vocabularies
from .common import small, text_bytes, written  # noqa: F401

#: A document is held out if the CRC-32 of its id as text leaves this remainder.
FOLDS, HELD_OUT = 7, 2
#: Words with the greatest counts that every task holds, and the bytes that such a word has at most.
TOP_WORDS, TOP_BYTES = 1 << 16, 64
#: Windows that one task trains on, at least and at most, and trainers of a round between; passes over the windows of a round, step size.
TRAINER_WINDOWS, MOST_WINDOWS, TRAINERS, PASSES, RATE = 1 << 17, 1 << 20, 16, 1, 0.01
#: Parts of the training documents, by a hash of their id, that each round takes: the first rounds only find the way, the last gets half.
SHARES = (1, 1, 2, 4)
#: Windows that a trainer holds and shuffles at a time, and consecutive windows of a text that go to a trainer in one row.
HELD_WINDOWS, WINDOWS_A_ROW = 1 << 16, 16
#: Trainers averaged in one group, and numbers of a slice of their parameters, each of which is averaged by itself.
FAN_IN, SLICE = 64, 1 << 14
#: Distinct words that a worker counts before it hands them on, words whose subwords it remembers, and words that are encoded at once.
COUNTED, REMEMBERED, WORDS_AT_ONCE = 300_000, 400_000, 100_000
#: Texts that are cut into words together.
ROWS = 1024
#: Stands for the end of a text among the words; no word holds a line end.
END = b"\n"
#: Fills a window after the end of its text; no subword has this id.
_AFTER = np.iinfo(np.uint16).max


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different A-Z lower-cased words of some texts (binary), which of them each word is, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    ends, flat = lists.offsets.to_numpy(), lists.flatten()
    # White space at a text's ends leaves an empty word there.
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    found = pc.filter(flat, real).dictionary_encode()
    return found.dictionary.cast(pa.binary()), found.indices.to_numpy(), np.diff(upto[ends - ends[0]])


def _spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other: each from its first on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Subwords:
    """Ids of words under a public byte vocabulary, each word with a blank before it."""

    def __init__(self, folder: str, name: str):
        self.encoding, _ = vocabularies.byte_bpe(folder, name)
        self.known: dict[bytes, bytes] = {}
        self.begins = np.array([self.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.encoding.n_vocab)])

    def text(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words as a text with one blank before each; long texts are encoded in parts."""
        parts = [(b" " + b" ".join(words[at : at + WORDS_AT_ONCE])).decode() for at in range(0, len(words), WORDS_AT_ONCE)]
        return np.array([i for part in parts for i in self.encoding.encode_ordinary(part)], np.int64)

    def texts(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of several texts. What the words of earlier texts gave is remembered, up to a bound."""
        words = {w for text in texts for w in text}
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(words)
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            ids, of = self.each(some)
            data, ends = ids.astype(np.uint16).tobytes(), (2 * np.cumsum(np.bincount(of, minlength=len(some)))).tolist()
            self.known.update(zip(some, (data[a:b] for a, b in zip([0, *ends], ends))))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, text)), np.uint16) for text in texts]

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and which word each belongs to."""
        ids = self.text(words)
        of = np.cumsum(self.begins[ids]) - 1
        if len(ids) and (of[0] < 0 or of[-1] != len(words) - 1):
            # Some word has white space of its own that runs on into the next blank.
            single = [self.text([w]) for w in words]
            return np.concatenate(single), np.repeat(np.arange(len(words)), list(map(len, single)))
        return ids, of


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c long) over train(text): A-Z lower-cased words, and END once for each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in small(batches, ROWS):
            words, which, _ = _words(batch.column(0))
            for w, c in zip(words.to_pylist(), np.bincount(which, minlength=len(words)).tolist()):
                counts[w] += c
            counts[END] += batch.num_rows
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return train.select("text").mapInArrow(each, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, folder: str, name: str) -> np.ndarray:
    """How often each subword id, and the end as the last, stands in the counted words: as many numbers as the vocabulary has ids."""
    ids = vocabularies.byte_bpe(folder, name)[0].n_vocab

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, total = Subwords(folder, name), np.zeros(ids + 1, np.int64)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            plain = np.array([w != END for w in words])
            total[ids] += c[~plain].sum()
            found, of = subwords.each([w for w in words if w != END])
            np.add.at(total, found, c[plain][of])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "c"])

    rows = counts.mapInArrow(each, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(ids + 1, np.int64)
    total[rows["id"].to_numpy()] = rows["c"].to_numpy()
    return total



def training_windows(train: DataFrame, lex: attention.Lexicon, folder: str, name: str) -> DataFrame:
    """(k long, ids binary) from train(doc_id, text): the windows of each text, see windows_of(), one in a row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(folder, name)
        for batch in small(batches, ROWS):
            data, ends = known.texts(batch.column(1))[-2:]
            ids = [data[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return windows_of(train.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids binary"), lex, 1)


def windows_of(encoded: DataFrame, lex: attention.Lexicon, a_row: int = WINDOWS_A_ROW) -> DataFrame:
    """(k long, ids binary) from encoded(doc_id, ids): each text, with an end before and after it, in windows of WINDOW + 1 ids (2 bytes each), `a_row` consecutive ones in a row.

    A window begins with the last id of the one before it, so every token of a
    text and its end is a target once. What lies after the end is _AFTER.
    """
    size, end = attention.WINDOW, lex.end
    if end >= _AFTER:
        raise ValueError("ids go into two bytes")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, data = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(text, np.uint16)
                n = -(-(len(ids) + 1) // size)
                line = np.full(n * size + 1, _AFTER, np.uint16)
                line[1 : len(ids) + 1] = ids
                line[[0, len(ids) + 1]] = end
                cut = line[np.arange(n)[:, None] * size + np.arange(size + 1)].tobytes()
                own, step = str(doc).encode(), 2 * (size + 1) * a_row
                data += [cut[at : at + step] for at in range(0, len(cut), step)]
                keys += [xxhash.xxh64_intdigest(b"%s %d" % (own, k)) >> 1 for k in range(-(-n // a_row))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["k", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "k long, ids binary")


def _train_share(start: np.ndarray, lex: attention.Lexicon):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, held, n, seen = attention.Trainer(attention.unflat(start), lex, RATE), [], 0, 0

        def learn() -> None:
            ids = np.frombuffer(b"".join(held), np.uint16).reshape(-1, attention.WINDOW + 1)
            real = ids[:, 1:] != _AFTER
            ids = np.where(ids == _AFTER, lex.end, ids.astype(np.int32))
            for _ in range(PASSES):
                trainer.learn(ids, real)

        for batch in batches:
            for ids in batch.column(1).to_pylist():
                held.append(ids)
                n += len(ids) // (2 * (attention.WINDOW + 1))
                if n >= HELD_WINDOWS:
                    learn()
                    seen, n = seen + n, 0
                    held.clear()
        if n:
            learn()
            seen += n
        if seen:
            # What a trainer hasn't met is zero here, and takes little room.
            values = attention.flat(trainer.p).astype("<f4") - start
            parts = [values[at : at + SLICE].tobytes() for at in range(0, len(values), SLICE)]
            one = [TaskContext.get().partitionId()] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())], ["trainer", "slice", "weight", "p"])

    return each


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (trainer, slice, weight, p, g) in order of g, slice and trainer: the weighted mean of each slice over the trainers of a group, held as one sum at a time."""
    key, weight, total = None, 0.0, None

    def mean() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], ["trainer", "slice", "weight", "p"])

    for batch in batches:
        for k in range(batch.num_rows):
            here, w = (batch.column(4)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].as_py()
            values = np.frombuffer(batch.column(3)[k].as_buffer(), "<f4").astype(np.float64)
            if here != key:
                if key is not None:
                    yield mean()
                key, weight, total = here, 0.0, np.zeros(len(values))
            weight += w
            total += w * values
    if key is not None:
        yield mean()


def averaged(found: DataFrame, trainers: int) -> np.ndarray | None:
    """The weighted mean of changes(trainer, slice, weight, p), of about `trainers`, in groups of FAN_IN at a time; None without any.

    Each slice goes its own way, so a task holds two slices, whatever the number of
    trainers and parameters. The sums run in the order of the trainers. How many
    there are is read from the rows, as more tasks than were asked for may have
    trained; the driver gets one row a slice in any case.
    """
    trainers = max(trainers, (found.agg(F.max("trainer")).first()[0] or 0) + 1)
    while trainers > 1:
        grouped = found.withColumn("g", F.floor(F.col("trainer") / FAN_IN)).repartition("g", "slice").sortWithinPartitions("g", "slice", "trainer")
        found = grouped.mapInArrow(_means, "trainer long, slice int, weight double, p binary")
        trainers = math.ceil(trainers / FAN_IN)
    parts = [r.p for r in found.orderBy("slice").select("p").collect()]
    return np.frombuffer(b"".join(parts), "<f4") if parts else None


def train_model(train: DataFrame, lex: attention.Lexicon, n_windows: float) -> attention.Params:
    """Training on all windows of train(doc_id, ids), about n_windows, in rounds; after each an average over the trainers.

    Windows are dealt to trainers and put in order by a hash of document and place, so
    the result doesn't depend on how the input is split, but for sums of floats.
    """
    params, done = attention.flat(attention.initial(lex.class_share, rows=len(lex.row))), 0
    share = F.pmod(F.xxhash64("doc_id"), F.lit(sum(SHARES)))
    for part in SHARES:
        mine = train.where((share >= done) & (share < done + part))
        expected = n_windows * part / sum(SHARES)
        # Many windows for each trainer keep the parameters that are averaged few beside them.
        trainers = max(1, math.ceil(expected / min(MOST_WINDOWS, max(TRAINER_WINDOWS, expected / TRAINERS))))
        # A shuffle may have more partitions than asked for; trainers with few windows each would learn little and hand on much.
        windows = windows_of(mine, lex).repartition(trainers, "k").coalesce(trainers).sortWithinPartitions("k", "ids")
        found = written(windows.mapInArrow(_train_share(params, lex), "trainer long, slice int, weight double, p binary"), "trained")
        if (mean := averaged(found, trainers)) is not None:
            params = params + mean
        discard(found)
        done += part
    return attention.unflat(params)


class Known:
    """Words of the texts of a task under numbers, with what is known of each: log10 of its count and one (0 if it is no top word) and its subwords. A bounded number is remembered."""

    def __init__(self, folder: str, name: str, top: dict[bytes, int] | None = None):
        self.subwords, self.top = Subwords(folder, name) if name else None, top or {}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.log, self.first, self.n, self.pool = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _learn(self, new: list[bytes]) -> None:
        self.log = np.r_[self.log, np.log10([self.top.get(w, 0) + 1 for w in new])]
        if self.subwords is None:
            return
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            ids, of = self.subwords.each(some)
            n = np.bincount(of, minlength=len(some))
            self.first, self.n = np.r_[self.first, len(self.pool) + np.cumsum(n) - n], np.r_[self.n, n]
            self.pool = np.r_[self.pool, ids.astype(np.uint16)]

    def texts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different words of the texts and their logs, which of them each word is, how many words each text has; subword ids one text after the other, and where each text's end."""
        words, which, n_words = _words(texts)
        if len(self.number) + len(words) > REMEMBERED:
            self._clear()
        before = len(self.log)
        mine = np.fromiter(map(self.number.__getitem__, words.to_pylist()), np.int64, len(words))
        if new := len(self.number) - before:
            self._learn(list(islice(reversed(self.number), new))[::-1])
        if self.subwords is None:
            return words, self.log[mine], which, n_words, self.pool, np.zeros(len(n_words), np.int64)
        sizes = self.n[mine][which]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(n_words)]
        return words, self.log[mine], which, n_words, self.pool[_spread(self.first[mine][which], sizes)], ends


ENCODED = "doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<struct<word: binary, n: int>>, ids binary"


def encoded(docs: DataFrame, top: dict[bytes, int], folder: str, name: str) -> DataFrame:
    """Each document with its sums over the top words, its other words with their counts, and its subword ids (2 bytes each; none without a vocabulary's name)."""
    sent = docs.sparkSession.sparkContext.broadcast(top)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(folder, name, sent.value)
        of_end = math.log10(sent.value.get(END, 0) + 1)
        for batch in small(batches, ROWS):
            words, log, which, n_words, data, ends = known.texts(batch.column(2))
            rows, log_of = len(n_words), log[which]
            of = np.repeat(np.arange(rows), n_words)
            common = log_of > 0
            base = np.bincount(of, log_of, rows) + of_end
            n_known = np.bincount(of[common], minlength=rows) + (of_end > 0)
            # Other words in order of text and word.
            pairs, n = np.unique(of[~common] * len(words) + which[~common], return_counts=True)
            other = words.take(pa.array(pairs % max(1, len(words))))
            places = np.r_[0, np.cumsum(np.bincount(pairs // max(1, len(words)), minlength=rows))]
            rare = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays([other, pa.array(n, pa.int32())], ["word", "n"])).cast(rare_type)
            ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.r_[0, 2 * ends].astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), rare, ids],
                ["doc_id", "held_out", "n_tokens", "known", "base", "rare", "ids"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(each, ENCODED)


def _scored(done: DataFrame, lex: attention.Lexicon, params: attention.Params) -> DataFrame:
    """The columns of done(row, ..., ids), with the model's score in place of the ids."""
    sent = done.sparkSession.sparkContext.broadcast((lex, params))
    out = done.drop("ids").withColumn("score", F.lit(0.0)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, params = sent.value
        scorer = attention.Scorer(params, lex)
        for batch in small(batches):
            ids = [np.frombuffer(x, np.uint16) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scorer.score(ids))], out.names)

    return done.mapInArrow(each, out)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")


def _encoded(slim: DataFrame, counts: DataFrame, folder: str, name: str, top_words: int) -> DataFrame:
    """encoded() of slim(doc_id, held_out, text) with row numbers, under the most frequent of the written word counts."""
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0]
    rows = counts.where(F.octet_length("word") <= TOP_BYTES).orderBy(F.col("c").desc(), "word").limit(top_words).toArrow()
    top = dict(zip(rows["word"].to_pylist(), rows["c"].to_pylist())) | ({END: ends} if ends else {})
    # Written, so that no text is encoded twice and the row numbers stay as they are.
    return written(encoded(slim, top, folder, name).withColumn("row", F.monotonically_increasing_id()), "encoded")


def _all_scores(done: DataFrame, counts: DataFrame, model: tuple[attention.Lexicon, attention.Params] | None) -> DataFrame:
    """The columns of scores() from encoded documents and written word counts; score is null without a model."""
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    rare = done.select("row", F.explode("rare").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("n_more"))
    slim = done.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "ids")
    scored = slim.withColumn("score", F.lit(None).cast("double")) if model is None else _scored(slim, *model)
    return scored.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("n_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))).alias("base_score"),
        "score",
    )


def base_scores(docs: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """scores() without the column score, for which alone a model is trained; these columns rest on the words only."""
    slim = _slim(docs)
    counts = written(word_counts(slim.where(~F.col("held_out"))), "word-counts")
    return _all_scores(_encoded(slim, counts, "", "", top_words), counts, None).drop("score")


def scores(docs: DataFrame, folder: str = vocabularies.FOLDER, name: str = vocabularies.BYTE_BPE, top_words: int = TOP_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    base_score is the add-one log10 score of the document's words and its end under
    the counts of the training documents; score is the attention model's log10
    probability of the lower-cased text. A null text counts as an empty one, whose
    only token is the end. Rows are scored one by one, whatever their ids, and
    repeated rows each; other columns don't matter. Without training documents no
    token is known and the model is its start. No documents give no rows.
    """
    slim = _slim(docs)
    train = slim.where(~F.col("held_out"))
    counts = written(word_counts(train), "word-counts")
    encoding, _ = vocabularies.byte_bpe(folder, name)
    seen = subword_counts(counts, folder, name)
    lex = attention.lexicon(seen, [encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)] + [b""])
    done = _encoded(slim, counts, folder, name, top_words)
    params = train_model(done.where(~F.col("held_out")), lex, seen.sum() / attention.WINDOW + seen[-1])
    return _all_scores(done, counts, (lex, params))
