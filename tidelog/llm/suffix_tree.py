"""Language-model scores by a probabilistic suffix tree over words.

A text's symbols are its words and an end; a symbol's context is up to DEPTH words before it, with ends before the start.  A context that occurs LEAST
times in training, whatever the size of the corpus, becomes a state of the tree if the symbols that follow it diverge from what its
suffix predicts: each occurrence is predicted from all others of the context, and the log likelihood gained that way over the suffix's prediction has to pass
GAIN.  So followers seen once speak against a state, and chance alone makes none.  A state's next-symbol distribution is
its counts smoothed with its longest suffix state's distribution, which counts as much as SMOOTH occurrences of each distinct follower; the root is
the distribution of single words with add-a-half counts, in which all unseen words together are one.  Each symbol is scored in the longest state that fits.

The tree is nowhere whole.  Word counts come first: each block of documents sends its distinct words with their counts to buckets, which add them up,
number the words and answer each block; the documents are then kept as numbers.  Contexts that end in one word are in one bucket, whose states of all
lengths are grown there; it answers every block with the probabilities of the symbols in context that the block sent.  A context with more than HOT
occurrences is spread: what follows it is dealt out by context and follower together, and only its number of distinct followers and its gain, a row for each such
context, come together; the contexts that end in it are dealt out by the word before.  Results don't depend on HOT.

Corner cases: a null or empty text is the end alone; a null id is training; repeated ids and rows are scored one by
one, and count as often as they are there; without any training document all counts are zero and the tree is a root
with the one unseen symbol; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.blocks import read_block, spread, write_blocks
from tidelog.llm.memory import tidy, tidy_group
from tidelog.llm.shared import crc_mod5, filesystem, materialize, texts, work_dir

#: Words of the longest context; occurrences that a state needs; log likelihood that it has to gain; weight of its suffix, for each distinct follower.
DEPTH, LEAST, GAIN, SMOOTH = 2, 2, 2.0, 8.0
#: Occurrences of a context from which on it is spread over buckets.
HOT = 1 << 21
#: Buckets of contexts at least, and bytes of text in a block.
GRAM_BUCKETS, BLOCK = 256, 8 << 20
END = 0
NAMED = "block long, path string, training long, words binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.encode().lower().split()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each by its bytes, all first ones first, as sorted numbers compress well that way."""
    n = len(columns[0])
    planes = b"".join([np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns]) if n else b""
    return np.array([n], "<u8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    wide = [np.dtype(t).itemsize for t in types]
    planes, out, at = pa.decompress(data[8:], n * sum(wide), codec="zstd", asbytes=True), [], 0
    for t, w in zip(types, wide):
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(8)


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Each bucket of sorted bucket numbers that has any, and where it is."""
    at = np.searchsorted(bucket, np.arange(n + 1))
    return ((int(b), slice(at[b], at[b + 1])) for b in np.flatnonzero(np.diff(at)))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in any order, and which of them each key is."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def distinct_rows(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns under 2 ** 32, in any order, and which of them each row is."""
    number = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key, inverse = numbered(number << np.uint64(32) | c.astype(np.uint64))
        number = inverse.astype(np.uint64)
    key, inverse = numbered(number)
    first = np.empty(len(key), np.int64)
    first[inverse] = np.arange(len(inverse))
    return [c[first] for c in columns], inverse


def of_each(inverse: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The value that all rows of each distinct one share."""
    out = np.empty(n, values.dtype)
    out[inverse] = values
    return out


@dataclass(frozen=True)
class Context:
    """What its followers say of each context: occurrences, distinct followers, and whether it is a state."""

    total: np.ndarray
    kinds: np.ndarray
    state: np.ndarray


def predicted(x: np.ndarray, p: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The probability of a follower seen x times after a state."""
    return (x + SMOOTH * kinds * p) / np.maximum(total + SMOOTH * kinds, 1e-9)  # without followers there is no state


def gain_of(x: np.ndarray, p: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What each seen follower adds to its context's gain: its occurrences, each predicted from the others, against its suffix's prediction."""
    others = kinds - (x == 1)
    return np.where(others > 0, x * np.log(np.maximum(predicted(x - 1, p, total - 1, others), 1e-300) / p), 0.0)


def states_of(group: np.ndarray, x: np.ndarray, p: np.ndarray, n: int) -> Context:
    """Of n contexts, whose followers with counts and suffix predictions are rows."""
    seen = x > 0
    total, kinds = np.bincount(group, x, n), np.bincount(group[seen], minlength=n)
    gain = np.bincount(group[seen], gain_of(x[seen], p[seen], total[group[seen]], kinds[group[seen]]), n)
    return Context(total, kinds, (total >= LEAST) & (gain > GAIN))


def grow(contexts: list[np.ndarray], symbol: np.ndarray, counts: np.ndarray, p: np.ndarray, known: int = 0) -> np.ndarray:
    """The probability of each row's symbol after its words (the last one first), with counts in training and predictions by the first ``known`` words."""
    number = np.zeros(len(symbol), np.uint64)
    for length, word in enumerate(contexts, 1):
        context, number = numbered(number << np.uint64(32) | word.astype(np.uint64))
        number = number.astype(np.uint64)
        if length <= known:
            continue
        gram, inverse = numbered(number << np.uint64(32) | symbol.astype(np.uint64))
        group, x, before = (gram >> np.uint64(32)).astype(np.int64), np.bincount(inverse, counts, len(gram)), of_each(inverse, p, len(gram))
        c = states_of(group, x, before, len(context))
        p = np.where(c.state[group], predicted(x, before, c.total[group], c.kinds[group]), before)[inverse]
    return p


# -- words


def _words(manifest: DataFrame, n_buckets: int) -> DataFrame:
    """(kind, block, bucket, data): counts and numbers of each block's words, and of each bucket its words, tokens and the most frequent word's count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist()):
                row = read_block(path)
                (hashes,), (counts,) = unpack(row["hashes"][0].as_py(), "<u8"), unpack(row["counts"][0].as_py(), "<u4")
                bucket, order = _word_buckets(hashes, n_buckets)
                rows = [(b, block, pack(hashes[order[s]], counts[order[s]])) for b, s in by_bucket(bucket[order], n_buckets)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "block", "data"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        bucket, parts = int(group["bucket"].iat[0]), [unpack(d, "<u8", "<u4") for d in group["data"]]
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -sums))] = np.arange(len(keys))
        number = 1 + rank * n_buckets + bucket  # frequent words have small numbers; none is the end's
        if len(number) and int(number.max()) >= 1 << 32:
            raise OverflowError("more than 2 ** 32 distinct words; use larger blocks")
        rows, at = [("sums", -1, bucket, np.array([(sums > 0).sum(), sums.sum(), sums.max(initial=0)], "<u8").tobytes())], 0
        for block, (k, _) in zip(group["block"], parts):
            mine = inverse[at : at + len(k)]
            rows.append(("words", int(block), bucket, pack(number[mine].astype("<u4"), sums[mine].astype("<u8"))))
            at += len(k)
        return pd.DataFrame(rows, columns=["kind", "block", "bucket", "data"])

    sent = manifest.mapInArrow(tidy(send), "bucket int, block long, data binary")
    return sent.groupBy("bucket").applyInPandas(tidy_group(answer), "kind string, block long, bucket int, data binary")


def coded(table: pa.Table) -> pa.Table:
    """What is kept of a block's texts, in one row: the words as numbers in the block, the distinct words' hashes, and their counts in training."""
    docs, numbers = [words_of(t) for t in table["text"].to_pylist()], {}
    put, digest, sizes = numbers.setdefault, xxhash.xxh3_64_intdigest, [len(d) for d in docs]
    ids = np.array([put(w, len(numbers)) for words in docs for w in words], "<u4")
    hashes, held = np.array([digest(w) for w in numbers], "<u8"), table["held_out"].to_pylist()
    counts = np.bincount(ids[np.repeat(~np.array(held, bool), sizes)], minlength=len(numbers)).astype("<u4")
    return pa.table({"doc_id": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())), "held_out": [held], "n_words": pa.array([sizes], pa.list_(pa.int64())), "ids": [pack(ids)], "hashes": [pack(hashes)], "counts": [pack(counts)]})


def _word_buckets(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((hashes >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def _named(manifest: DataFrame, words: DataFrame, n_buckets: int) -> DataFrame:
    """NAMED: each block with the numbers and counts of its words, in the block's order."""

    def each(listed: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(zip(answered["bucket"], answered["data"])), []
        for block, path in zip(listed["block"], listed["path"]):
            row = read_block(path)
            (hashes,), held = unpack(row["hashes"][0].as_py(), "<u8"), row["held_out"][0].as_py()
            number, counts = np.zeros(len(hashes), "<u4"), np.zeros(len(hashes), "<u8")
            bucket, order = _word_buckets(hashes, n_buckets)
            for b, s in by_bucket(bucket[order], n_buckets):
                number[order[s]], counts[order[s]] = unpack(known[b], "<u4", "<u8")
            out.append((block, path, len(held) - sum(held), pack(number, counts)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in NAMED.split(", ")])

    return manifest.select("block", "path").groupBy("block").cogroup(words.where("kind = 'words'").groupBy("block")).applyInPandas(tidy_group(each), NAMED)


# -- symbols in context


@dataclass(frozen=True)
class Corpus:
    """Tokens, distinct symbols and ends in training, and from which count on a context is spread."""

    tokens: int
    distinct: int
    ends: int
    hot: int

    @property
    def bottom(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """The root's probabilities of symbols with these counts."""
        return ((counts.astype(float) + 0.5) / self.bottom).astype("<f4")


class BlockGrams:
    """A block's distinct symbols in context, with their counts in training and the root's probabilities."""

    def __init__(self, row: dict, corpus: Corpus):
        block = read_block(row["path"])
        self.corpus, self.doc_id = corpus, block["doc_id"][0].as_py()
        self.sizes, self.held = np.array(block["n_words"][0].as_py(), np.int64), np.array(block["held_out"][0].as_py(), bool)
        (ids,) = unpack(block["ids"][0].as_py(), "<u4")
        number, counts = unpack(row["words"], "<u4", "<u8")
        number, self.counts = np.append(np.uint32(END), number), np.append(corpus.ends, counts.astype(np.int64))  # the end is the block's symbol 0
        last = np.cumsum(self.sizes + 1) - 1  # where each document's end is
        self.starts = last - self.sizes
        stream = np.zeros(len(ids) + len(last), np.uint64)
        word = np.ones(len(stream), bool)
        word[last] = False
        stream[word] = ids + np.uint32(1)
        place = np.arange(len(stream)) - np.repeat(self.starts, self.sizes + 1)
        parts = [stream, *[np.where(place >= n, np.roll(stream, n), np.uint64(0)) for n in range(1, DEPTH + 1)]]
        wide = np.uint64(int(len(number)).bit_length())
        if (DEPTH + 1) * int(wide) <= 64:
            key = parts[-1]
            for part in parts[-2::-1]:
                key = key << wide | part
            key, self.of = numbered(key)
            local = [(key >> np.uint64(i) * wide & (np.uint64(1) << wide) - np.uint64(1)).astype(np.int64) for i in range(DEPTH + 1)]
        else:
            local, self.of = distinct_rows(*parts)
            local = [c.astype(np.int64) for c in local]
        self.symbol, *self.context = (number[c] for c in local)
        self.n = np.bincount(self.of[np.repeat(~self.held, self.sizes + 1)], minlength=len(self.symbol)).astype("<u4")
        self.seen, self.before = self.counts[stream.astype(np.int64)], self.counts[local[1]]  # of each place's symbol, of each gram's last word
        self.local, self.p = local[0], corpus.root(self.counts[local[0]])

    def rows(self, which: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct contexts of this length with their symbols, among some of the grams, and which of them each is."""
        return distinct_rows(*[c[which] for c in self.context[:length]], self.symbol[which])

    def resolve(self, about: list[dict], told: dict[int, dict[int, bytes]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Put in the probabilities after spread contexts; how many words of each gram's context that settles, and whether the next longer one is spread too."""
        times, length = self.before.copy(), np.zeros(len(self.symbol), np.int64)
        hot = times > self.corpus.hot
        for level, known in enumerate(about, 1):
            if not hot.any():
                break
            rows, of = self.rows(hot, level)
            x, bucket = np.zeros(len(rows[0]), np.int64), (mixed(*rows) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for b, s in by_bucket(bucket[order], n_buckets):
                (x[order[s]],) = unpack(told[level][b], "<u8")
            total, kinds, state = (np.array(c) for c in zip(*[known[tuple(r)] for r in np.column_stack(rows[:-1]).tolist()]))
            before = of_each(of, self.p[hot], len(rows[0])).astype(float)
            self.p[hot] = np.where(state, predicted(x, before, total, kinds), before)[of]
            length[hot] = level
            # the next longer context occurs as often as its last word follows the words before that; one that begins before the text, as often as this one
            follows = dict(zip(map(tuple, np.column_stack(rows).tolist()), x.tolist()))
            if level < DEPTH:
                longer = np.column_stack([c[hot] for c in self.context[: level + 1]]).tolist()
                times[hot] = [t if c[0] == END else follows.get((*c[1:], c[0]), 0) for t, c in zip(times[hot].tolist(), longer)]
                hot &= times > self.corpus.hot
            else:
                hot = np.zeros(len(hot), bool)
        return length, hot

    def asked(self, length: np.ndarray) -> np.ndarray:
        """Grams whose contexts may have states that aren't spread."""
        return np.flatnonzero((length < DEPTH) & ((length > 0) | (self.before >= LEAST)))

    def dealt(self, length: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(settled words, bucket, grams) of the grams to ask for, those of a context together."""
        some = self.asked(length)
        for known in np.unique(length[some]):
            mine = some[length[some] == known]
            mine = mine[np.argsort(self.context[0][mine].astype(np.uint64) << np.uint64(32) | self.context[1][mine])]  # in the order of contexts
            bucket = mixed(*[c[mine] for c in self.context[: known + 1]]) % np.uint64(n_buckets)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
            bucket = bucket.astype(np.int64)
            for b, s in by_bucket(bucket[order], n_buckets):
                yield int(known), b, mine[order[s]]


def over(named: DataFrame, told: DataFrame | None, each: Callable[[dict, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows made from each block and from what it was told before, by level and bucket."""
    names = [c.split()[0] for c in schema.split(", ")]
    if told is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    rows = list(each(batch.slice(i, 1).to_pylist()[0], {}))
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=_arrow(schema), preserve_index=False)

        return named.mapInArrow(tidy(alone), schema)

    def both(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, dict[int, bytes]] = {}
        for level, bucket, data in zip(answers["level"], answers["bucket"], answers["data"]):
            known.setdefault(level, {})[bucket] = data
        out = pd.DataFrame([r for row in rows.to_dict("records") for r in each(row, known)], columns=names)
        return out.astype({"doc_id": "Int64"}) if "doc_id" in names else out

    return named.groupBy("block").cogroup(told.select("block", "level", "bucket", "data").groupBy("block")).applyInPandas(tidy_group(both), schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])


# -- contexts that are spread


def _spread(named: DataFrame, told: DataFrame | None, corpus: Corpus, about: list[dict], n_buckets: int) -> DataFrame:
    """(block, level, bucket, data, most): counts of what follows spread contexts of the next length, for each block (and, for block -1, all of a bucket's; most: the highest)."""
    level = len(about) + 1
    types = ["<u4"] * (level + 1)

    def send(row: dict, known: dict) -> Iterator[tuple]:
        g = BlockGrams(row, corpus)
        _, hot = g.resolve(about, known, n_buckets)
        if not hot.any():
            return
        rows, of = g.rows(hot, level)
        n, p = np.bincount(of, g.n[hot], len(rows[0])).astype("<u4"), of_each(of, g.p[hot], len(rows[0]))
        bucket = (mixed(*rows) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, s in by_bucket(bucket[order], n_buckets):
            yield b, row["block"], pack(*[c[order[s]] for c in rows], n[order[s]], p[order[s]])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d, *types, "<u4", "<f4") for d in group["data"]]
        columns = [np.concatenate(c) for c in zip(*parts)]
        rows, of = distinct_rows(*columns[: level + 1])
        x = np.bincount(of, columns[-2], len(rows[0])).astype("<u8")
        p, seen, bucket, at, out = of_each(of, columns[-1], len(x)), x > 0, int(group["bucket"].iat[0]), 0, []
        for block, part in zip(group["block"], parts):
            out.append((int(block), level, bucket, pack(x[of[at : at + len(part[0])]]), 0))
            at += len(part[0])
        out.append((-1, level, bucket, pack(*[c[seen] for c in rows[:-1]], x[seen], p[seen]), int(x.max(initial=0))))
        return pd.DataFrame(out, columns=["block", "level", "bucket", "data", "most"])

    sent = over(named, told, send, "bucket int, block long, data binary")
    return sent.groupBy("bucket").applyInPandas(tidy_group(answer), "block long, level int, bucket int, data binary, most long")


def _about(found: DataFrame, level: int) -> dict[tuple, tuple]:
    """Occurrences, distinct followers and state of each spread context of a length: a row for each comes to the driver, at most one for each HOT tokens."""
    tables, names = found.where(f"level = {level} and block = -1").select("data"), [f"c{i}" for i in range(level)]
    schema = ", ".join(f"{n} long" for n in names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                *context, x, _ = unpack(data, *["<u4"] * level, "<u8", "<f4")
                rows, of = distinct_rows(*context)
                yield pa.record_batch([*(pa.array(c.astype(np.int64)) for c in rows), pa.array(np.bincount(of, x, len(rows[0])).astype(np.int64)), pa.array(np.bincount(of, minlength=len(rows[0])).astype(np.int64))], names=[*names, "total", "kinds"])

    sums = tables.mapInArrow(counted, f"{schema}, total long, kinds long").groupBy(*names).agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()
    known = {tuple(r[:level]): (r["total"], r["kinds"]) for r in sums}

    def gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                *context, x, p = unpack(data, *["<u4"] * level, "<u8", "<f4")
                rows, of = distinct_rows(*context)
                total, kinds = (np.array(c, float)[of] for c in zip(*[known[tuple(r)] for r in np.column_stack(rows).tolist()])) if len(of) else (np.zeros(0), np.zeros(0))
                gain = np.bincount(of, gain_of(x.astype(float), p.astype(float), total, kinds), len(rows[0]))
                yield pa.record_batch([*(pa.array(c.astype(np.int64)) for c in rows), pa.array(gain.astype(float))], names=[*names, "gain"])

    gains = tables.mapInArrow(gained, f"{schema}, gain double").groupBy(*names).agg(F.sum("gain").alias("gain")).collect()
    return {tuple(r[:level]): (*known[tuple(r[:level])], r["gain"] > GAIN) for r in gains}


# -- scores


def _answers(named: DataFrame, told: DataFrame | None, corpus: Corpus, about: list[dict], n_buckets: int) -> DataFrame:
    """(block, level, bucket, data): for each block's grams bits that say where states change the probability, and log10 of it there.

    ``level`` is negative: less the number of settled words, less one.
    """

    def send(row: dict, known: dict) -> Iterator[tuple]:
        g = BlockGrams(row, corpus)
        length, _ = g.resolve(about, known, n_buckets)
        for settled, b, some in g.dealt(length, n_buckets):
            # before any word is settled the prediction is the root's, for which the symbol's count stands: it packs better
            said = g.p[some] if settled else g.counts[g.local[some]].astype("<u8")
            yield settled, b, row["block"], pack(*[c[some] for c in g.context], g.symbol[some], g.n[some], said)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        settled, bucket = int(group["settled"].iat[0]), int(group["bucket"].iat[0])
        parts = [unpack(d, *["<u4"] * (DEPTH + 2), "<f4" if settled else "<u8") for d in group["data"]]
        *words, n, said = (np.concatenate(c) for c in zip(*parts))
        before = (said if settled else corpus.root(said)).astype(float)
        p = grow(words[:-1], words[-1], n, before, settled)
        ends = np.cumsum([len(x[0]) for x in parts])[:-1]
        data = [np.packbits(c).tobytes() + np.log10(x[c]).astype("<f4").tobytes() for c, x in zip(np.split(p != before, ends), np.split(p, ends))]
        return pd.DataFrame({"block": group["block"].to_numpy(), "level": -1 - settled, "bucket": bucket, "data": data})

    sent = over(named, told, send, "settled int, bucket int, block long, data binary")
    return sent.groupBy("bucket", "settled").applyInPandas(tidy_group(answer), "block long, level int, bucket int, data binary")


def score_documents(spark: SparkSession, docs: DataFrame, held_out_fold: int = 1, block_bytes: int = BLOCK, hot: int = HOT) -> DataFrame:
    """SCORES of every document, learning from those outside the held-out fold."""
    folder = work_dir(spark, "suffix-tree")
    source = texts(docs, F.coalesce(crc_mod5() == held_out_fold, F.lit(False)).alias("held_out"))
    manifest = write_blocks(source, f"{folder}/blocks", block_bytes, coded)
    spaced, n_blocks = spread(manifest)
    n_words, n_grams = max(8, n_blocks // 2), max(GRAM_BUCKETS, n_blocks)
    words = materialize(_words(spaced, n_words), f"{folder}/words")
    sums = [np.frombuffer(r["data"], "<u8") for r in words.where("kind = 'sums'").select("data").collect()]  # a row for each bucket
    named = materialize(_named(manifest, words, n_words), f"{folder}/named")
    ends = named.agg(F.sum("training")).first()[0] or 0
    corpus = Corpus(int(sum(int(s[1]) for s in sums)) + ends, int(sum(int(s[0]) for s in sums)) + (ends > 0), ends, hot)
    drop(f"{folder}/words")
    named, _ = spread(named)

    about, told = [], None
    most = max([ends, *(int(s[2]) for s in sums)])
    while most > hot and len(about) < DEPTH:
        found = materialize(_spread(named, told, corpus, about, n_grams), f"{folder}/spread-{len(about)}")
        about = [*about, _about(found, len(about) + 1)]
        most = max(ends, found.agg(F.max("most")).first()[0] or 0)
        rows = found.where("block >= 0").drop("most")
        told = rows if told is None else told.union(rows)
    answers = _answers(named, told, corpus, about, n_grams)
    told = answers if told is None else told.union(answers)

    def score(row: dict, known: dict) -> Iterator[tuple]:
        g = BlockGrams(row, corpus)
        length, _ = g.resolve(about, known, n_grams)
        logs = np.log10(g.p.astype(float))
        for settled, b, some in g.dealt(length, n_grams):
            data, n = known[-1 - settled][b], -(-len(some) // 8)
            logs[some[np.unpackbits(np.frombuffer(data, np.uint8, n), count=len(some)).view(bool)]] = np.frombuffer(data, "<f4", -1, n)
        base = np.add.reduceat(np.log10(g.seen + 0.5) - np.log10(corpus.bottom), g.starts)
        score, seen = np.add.reduceat(logs[g.of], g.starts), np.add.reduceat((g.seen > 0).astype(np.int64), g.starts)
        for i, doc_id in enumerate(g.doc_id):
            yield doc_id, bool(g.held[i]), int(g.sizes[i]) + 1, int(seen[i]), corpus.tokens, float(base[i]), float(score[i])

    return over(named, told, score, SCORES)


def drop(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.delete_dir(path)
