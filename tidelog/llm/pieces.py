"""N-best encoding with the pieces of a SentencePiece model, and decoding.

A text's segmentations are the paths of a lattice with an edge for each piece found in it, weighing the piece's score.
Forward Viterbi gives the best score of reaching each place from the left.  Searching backwards from the end, that
score is exactly what the rest of a path can still gain, so A-star with it takes complete paths off its queue in the
order of their scores, and never looks at a path that isn't among the best.

Where two neighbouring characters stand together in no piece, no path goes across.  So the lattice of a text is a chain
of small ones.  The n best paths of a text differ from the best one in the n - 1 words whose second best path loses
least, and that loss is known from forward and backward scores: only those words are searched.
Among equal scores the order is fixed: a word's ways in the order in which the search meets them, and of parts that
lose equally the earlier one changes first.

Corner cases: a null or empty text has one segmentation without pieces; a text with fewer segmentations than asked
has as many rows; null and repeated ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from bisect import insort
from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.memory import hold, tidy
from tidelog.llm.shared import texts

#: Words kept in each of a process's two caches, and the longest that is kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 60
#: What a character without a piece loses against the worst piece.
UNKNOWN_LOSS = 10.0
SPACE = "▁"
_BY_PATH: dict[tuple[str, int], PieceLattice] = {}


def _pack(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceLattice:
    """The pieces of a model; ``n``: how many segmentations to find."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        self.n, self.model = n, sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        every = range(m.get_piece_size())
        self.text = [m.id_to_piece(i) for i in every]
        self.bytes = {int(self.text[i][3:-1], 16): i for i in every if m.is_byte(i)}
        # a byte that isn't a character by itself stands as a lone surrogate until all of its character is there
        byte_of = {i: chr(b) if b < 0x80 else chr(0xDC00 + b) for b, i in self.bytes.items()}
        self.spelled = [byte_of.get(i, t) for i, t in enumerate(self.text)]
        self.no_bytes = re.compile("[\udc80-\udcff]")
        special = {i for i in every if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        scores = [m.get_score(i) for i in every if i not in special and m.get_score(i) > -1e8]
        floor = min(scores, default=0.0)
        # pieces that only spell runs of spaces have no rank of their own; they weigh as much as the worst one
        self.pieces = {self.text[i]: (max(m.get_score(i), floor), i) for i in every if i not in special}
        self.unknown = floor - UNKNOWN_LOSS
        self.trie: dict[str, tuple[dict, tuple[float, int] | None]] = {}  # character to (what follows, the piece that ends here)
        for p in sorted(self.pieces):
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, self.pieces[p])
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        line = "" if any("\n" in p for p in self.pieces) else "\n"
        self.words = re.compile(r"(?s).+" if crossing else rf"{line}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}  # neighbours in some piece
        self.packed = [_pack((i,)) for i in every]
        self.lone = ({}, (self.unknown, -1))  # a character that begins no piece
        self.first = {c: (node, piece or self.lone[1]) for c, (node, piece) in self.trie.items()}
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.recent_parts: dict[str, tuple] = {}
        self.older_parts: dict[str, tuple] = {}

    def _unknown_ids(self, char: str) -> tuple[int, ...]:
        found = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return (self.model.unk_id(),) if None in found else tuple(found)

    def _forward(self, word: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """The lattice's edges (from, score, id) by their end, and the best score of reaching each place."""
        size, unknown, roots = len(word), self.unknown, self.trie
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [-1e300] * size
        for start in range(size):
            here, end = best[start], start + 1
            found = roots.get(word[start])
            if found is None or found[1] is None:
                into[end].append((start, unknown, -1))
                if here + unknown > best[end]:
                    best[end] = here + unknown
            while found is not None:
                node, piece = found
                if piece is not None:
                    score, i = piece
                    into[end].append((start, score, i))
                    score += here
                    if score > best[end]:
                        best[end] = score
                if end == size:
                    break
                found = node.get(word[end])
                end += 1
        return into, best

    def best(self, word: str) -> tuple[float, bytes, float]:
        """Score and ids of the best segmentation, and what the second best loses against it (infinite if there is none).

        Each place has the scores of the two best paths to it; another path there is one by another last edge, or the
        second best to where the best one's last edge begins.  Of equal ones the longest last edge is the best one's.
        """
        size, first, lone = len(word), self.first, self.lone
        best, other = [0.0] + [-1e300] * size, [-1e300] * (size + 1)
        came, by = [0] * (size + 1), [-1] * (size + 1)  # the best path's last edge
        for start in range(size):
            here, end = best[start], start
            node, piece = first.get(word[start]) or lone
            while True:
                end += 1
                if piece is not None:
                    gain, i = piece
                    score = here + gain
                    if score > (was := best[end]):
                        best[end], came[end], by[end] = score, start, i
                        gain += other[start]
                        other[end] = was if was > gain else gain
                    elif score > other[end]:
                        other[end] = score
                if end == size or (found := node.get(word[end])) is None:
                    break
                node, piece = found
        ids: list[bytes] = []
        end = size
        while end:
            start, i = came[end], by[end]
            ids.append(self.packed[i] if i >= 0 else _pack(self._unknown_ids(word[start:end])))
            end = start
        ids.reverse()
        total, second = best[-1], other[-1]
        return total, b"".join(ids), total - second if second > -1e299 else float("inf")

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations, best first.

        Each entry of the queue stands for a path of its own, worth just its key; so whatever is worth less than as many
        entries as are still wanted can go at once, and the queue never holds more than n.
        """
        into, best = self._forward(word)
        out: list[tuple[float, tuple[int, ...]]] = []
        # (negative of what the whole path gains, order of entry, place, gained so far, path behind it), sorted
        queue: list[tuple] = [(-best[-1], 0, len(word), 0.0, None)]
        entry = 0
        while queue and len(out) < n:
            _, _, at, gained, path = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    start, end, i, path = path
                    ids += (i,) if i >= 0 else self._unknown_ids(word[start:end])
                out.append((gained, tuple(ids)))
                continue
            room = n - len(out)
            for start, score, i in into[at]:
                worth = -(best[start] + score + gained)
                if len(queue) < room or worth < queue[-1][0]:
                    entry += 1
                    insort(queue, (worth, entry, start, score + gained, (start, at, i, path)))
                    if len(queue) > room:
                        queue.pop()
        return out

    def parts(self, word: str) -> list[str]:
        """The word cut wherever no piece goes across: each part's lattice is apart."""
        inside, at, out = self.inside, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def entry(self, word: str) -> tuple[float, bytes, float, str]:
        """Best score, its ids, the loss of the second best, and the word itself, put together from the word's parts."""
        found = self.older.get(word)
        if found is None:
            score, ids, loss = 0.0, b"", float("inf")
            for part in self.parts(word):
                some = self.recent_parts.get(part) or self.older_parts.get(part)
                if some is None:
                    some = self.best(part)
                if len(part) <= CACHE_CHARS:
                    self.recent_parts[part] = some
                gain, packed, lost = some
                score, ids, loss = score + gain, ids + packed, lost if lost < loss else loss
            found = (score, ids, loss, word)
        if len(word) <= CACHE_CHARS:
            self.recent[word] = found
            if len(self.recent) >= CACHE_WORDS:  # what was used lately outlives the change
                self.older, self.recent = self.recent, {}
                self.older_parts, self.recent_parts = self.recent_parts, {}
        return found

    def normalize(self, text: str) -> str:
        return self.model.normalize(text)

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """(score, ids as little-endian unsigned 32-bit integers) of the n best segmentations of a normalized text."""
        return [(score, ids) for score, ids, _ in self.encoded(text)]

    def encoded(self, text: str) -> list[tuple[float, bytes, bool]]:
        """``encode``, and whether the ids spell what those of the best one do: they are spelled where they differ."""
        words = self.words.findall(text)
        entries = list(map(self.recent.get, words))
        for i, e in enumerate(entries):
            if e is None:
                entries[i] = self.recent.get(words[i]) or self.entry(words[i])
        ids = [e[1] for e in entries]
        total = sum([e[0] for e in entries])
        losses = [e[2] for e in entries]
        if self.n == 1 or not losses:
            return [(total, b"".join(ids), True)]
        # whichever the n best are, they differ from the best in the n - 1 words that lose least; only those are searched
        limit = sorted(losses)[: self.n - 1][-1]
        change = sorted([(x, i) for i, x in enumerate(losses) if x <= limit < 1e300 or x < limit])[: self.n - 1]
        ways_of = [self.nbest(entries[i][3], self.n) for _, i in change]
        ways = sorted((sum([w[0][0] - w[c][0] for c, w in zip(way, ways_of)]), way) for way in product(*[range(len(w)) for w in ways_of]))
        first = [self.spell(ids[i]) for _, i in change]
        out = []
        for loss, way in ways[: self.n]:
            same = True
            for c, (_, i), w, spelled in zip(way, change, ways_of, first):
                ids[i] = _pack(w[c][1])
                same = same and self.spell(ids[i]) == spelled
            out.append((total - loss, b"".join(ids), same))
        return out

    def spell(self, ids: bytes) -> str:
        """What the ids spell, with bytes that are no character by themselves as lone surrogates; what joined ids spell is so joined too."""
        return "".join(map(self.spelled.__getitem__, memoryview(ids).cast("I")))

    def decode(self, ids: bytes) -> str:
        """The normalized text that the ids spell, with its space marks as spaces; bytes that are no text show as such."""
        text = self.spell(ids).replace(SPACE, " ")
        return text if self.no_bytes.search(text) is None else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def lattice(path: str, n: int) -> PieceLattice:
    """This process's lattice of a model file."""
    if (path, n) not in _BY_PATH:
        gc.set_threshold(500_000, 20, 100)  # the caches hold millions of tuples without cycles; don't walk them all the time
        _BY_PATH[path, n] = PieceLattice(path, n)
        hold("pieces", _BY_PATH.clear)
    return _BY_PATH[path, n]


def nbest_segmentations(docs: DataFrame, model_path: str, n: int = 3, keep_ids: bool = False) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids_crc32, round_trip) of the n best segmentations of every whole text.

    ``round_trip``: decoding the ids gives the normalized text back.  ``keep_ids`` adds the ids as binary.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lattice(model_path, n)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    text = found.normalize(text)
                    plain = text.replace(SPACE, " ")
                    best = None
                    for rank, (score, ids, same) in enumerate(found.encoded(text), 1):
                        back = best if same and rank > 1 else found.decode(ids) == plain
                        best = back if rank == 1 else best
                        rows.append((doc_id, rank, score, len(ids) // 4, zlib.crc32(ids), back, ids))
                columns = list(zip(*rows)) if rows else [[]] * 7
                types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids"]
                keep = len(names) if keep_ids else len(names) - 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns[:keep], types)], names=names[:keep])

    schema = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids binary" * keep_ids
    return texts(docs).mapInArrow(tidy(each, "pieces"), schema)
