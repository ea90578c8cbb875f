"""Byte-pair encoding with a SentencePiece model, by vectorised merge rounds.

A text is cut where no piece of the vocabulary reaches across.  Of the distinct
cuts that a task hasn't met yet, all symbols lie in one flat array.  In each
round every word takes the least rank among its neighbouring pairs and merges
all its pairs of that rank at once, leftmost first; the array is compacted and
words without a pair leave, until none is left.

A round may merge several places of a word only if the merged piece is part of
no piece of the same or a better rank; such a piece could otherwise have come
first.  For the few other pieces a round merges the leftmost place alone, so
the result is always that of merging one pair at a time.

A long word is cut further where no piece holds the two characters beside each
other.  What stays long goes by rounds over a queue: places lie in order of their
ranks, a round takes the places of the least rank and touches only them and their
neighbours, so a text without spaces takes time in proportion to its length.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from fieldloom.llm.textbatch import pieces
from fieldloom.llm.wordcache import WordCache

SPACE = "▁"
#: Bytes of text that are encoded at once: the more, the fewer words come anew.
BATCH_BYTES = 4 << 20
#: Characters from which a word is cut where no piece reaches across, and symbols from which it goes by a queue.
CUT_CHARS, QUEUE_SYMBOLS = 64, 512
#: Places that a round over a queue takes at most; fewer while merged pieces may come before the next place.
QUEUE_PLACES = 1 << 16
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Pairs of symbols to merged symbols, by hashing with a few vectorised probes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, -1, np.int32)
        waiting, self.probes = np.arange(len(keys)), 0
        while len(waiting):
            slots = self._slot(keys[waiting], self.probes)
            free = self.values[slots] < 0
            _, first = np.unique(slots, return_index=True)
            take = np.zeros(len(waiting), bool)
            take[first] = True
            take &= free
            self.keys[slots[take]], self.values[slots[take]] = keys[waiting[take]], merged[waiting[take]]
            waiting = waiting[~take]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)) + np.uint64(probe * (probe + 1) // 2) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbols, -1 where a pair has none; negative symbols are in no pair."""
        keys = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for probe in range(self.probes):
            slots = self._slot(keys[todo], probe)
            hit = self.keys[slots] == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            todo = todo[~hit & (self.values[slots] >= 0)]
            if not len(todo):
                break
        return out


class PieceBpe:
    """Encoder and decoder for a BPE model with byte fallback, identity normalisation and a space put in front."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        if model.normalize(" a  ﬁ ") != SPACE + SPACE + "a" + SPACE * 2 + "ﬁ" + SPACE:
            raise ValueError("only models that keep texts as they are, after a space put in front, can be read")
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no pieces for single bytes")
        ids = {names[i]: i for i in range(n) if plain[i]}
        if any(SPACE in name.lstrip(SPACE) or "\n" in name for name in ids if len(name) > 1):
            raise ValueError("a piece reaches across words or lines")
        # characters that stand in pieces but aren't pieces are symbols, too, numbered after the vocabulary
        symbols = dict(ids)
        for name in ids:
            for c in name if len(name) > 1 else "":
                symbols.setdefault(c, n + len(symbols))
        self.size = n
        beside = {(ord(a) << 32) | ord(b) for name in ids for a, b in zip(name, name[1:])}
        self.beside = np.array(sorted(beside), np.uint64)  # characters that stand beside each other in a piece
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.char_of = {i: name for name, i in symbols.items() if len(name) == 1}
        pairs = [(symbols[name[:k]], symbols[name[k:]], i) for name, i in ids.items() if len(name) > 1 for k in range(1, len(name)) if name[:k] in symbols and name[k:] in symbols]
        left, right, merged = (np.array(x, np.int32) for x in zip(*pairs))
        self.table = PairTable(left, right, merged)
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        rank = np.concatenate([self.rank, np.full(max(symbols.values()) + 1 - n if symbols else 0, -1, np.int32)])
        self.single = np.zeros(n, bool)  # merge one place at a time
        for part in (left, right):
            risky = part[(part < n) & (self.rank[merged] <= rank[part])]
            self.single[risky] = True
        digits = [str(i).encode() + b"," for i in range(n)]
        self.id_text = np.zeros((n, max(map(len, digits))), np.uint8)
        for i, d in enumerate(digits):
            self.id_text[i, : len(d)] = list(d)
        self.id_text_size = np.array([len(d) for d in digits])
        surface = [bytes([int(names[i][3:-1], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() if plain[i] else b"" for i in range(n)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.cache = WordCache(self.encode_words, np.int32)

    _AS_IS = ("\n", SPACE)

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text in parts that no merge leaves: a line feed and what follows it, or spaces and what follows them; a single space in front is left out."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for part in parts:
            if part == "":
                spaces += 1
                continue
            if spaces and part[0] == "\n":
                out.append(SPACE * spaces)
                out.append(part)
            else:
                out.append(SPACE * (spaces + 1) + part if spaces else part)
            spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all, by merge rounds over all words; words have their spaces."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int32), symbols)  # negative: a character without a piece
        if (lengths <= CUT_CHARS).all():
            return self._merged(symbols, lengths)
        # long words in parts that no piece reaches across
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        pairs = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:]
        there = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        apart = (self.beside[there] != pairs) & (lengths[word[1:]] > CUT_CHARS)
        apart[ends[:-1] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(apart) + 1])
        sizes = np.diff(np.append(starts, len(points)))
        counts, out = np.zeros(len(starts), np.int64), np.empty(0, np.int32)
        short = sizes <= QUEUE_SYMBOLS
        inside = np.repeat(short, sizes)
        if short.any():
            counts[short], out = self._merged(symbols[inside], sizes[short])
        if not short.all():
            rest, parts = iter(np.split(out, np.cumsum(counts[short])[:-1])), []
            for k in range(len(starts)):
                if short[k]:
                    parts.append(next(rest))
                else:
                    done = self._merged_by_queue(symbols[starts[k] : starts[k] + sizes[k]])
                    ids = self._ids_of(np.zeros(len(done), np.int64), done)[1]
                    counts[k] = len(ids)
                    parts.append(ids)
            out = np.concatenate(parts)
        return np.bincount(word[starts], counts, len(words)).astype(np.int64), out

    def _ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], _NONE)

    def _merged_by_queue(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols that one long word is merged to.

        Of the least rank's places a round takes the leftmost ones.  If a merged
        piece made a pair of the same or a better rank with a neighbour, the round
        ends with that place, as the pair comes before the places to the right.
        """
        n = len(symbols)
        sym = symbols.astype(np.int32)  # the symbol that begins at each place
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        merged = np.full(n, -1, np.int32)
        merged[:-1] = self.table.find(sym[:-1], sym[1:])
        rank = self._ranks(merged)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            of = rank[places]
            places, of = places[of < _NONE], of[of < _NONE]
            if not len(places):
                return
            order = np.lexsort((places, of))
            places, of = places[order], of[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(of)]):
                r = int(of[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places[a:b])

        wait(np.arange(n))
        take = 64
        while ranks:
            r = ranks[0]
            lists = waiting[r]
            if len(lists) > 1:
                lists[:] = [np.unique(np.concatenate(lists))]
            window, rest = lists[0][:take], lists[0][take:]
            places = window[alive[window] & (rank[window] == r)]
            if len(places):
                # of places whose pairs overlap every other one, from the left
                begins = np.append(True, after[places[:-1]] != places[1:])
                run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                piece, second = merged[places], after[places]
                left, third = before[places], after[second]
                better = np.zeros(len(places), bool)
                for a, b, there in ((sym[np.maximum(left, 0)], piece, left >= 0), (piece, sym[np.minimum(third, n - 1)], third < n)):
                    better |= there & (self._ranks(self.table.find(a, b)) <= r)
                beside = np.append(third[:-1] == places[1:], False)
                better[:-1] |= beside[:-1] & (self._ranks(self.table.find(piece[:-1], piece[1:])) <= r)
                if better.any():
                    last = int(np.argmax(better))
                    rest = lists[0][np.searchsorted(lists[0], places[last], side="right") :]
                    places, second, third, piece, left = places[: last + 1], second[: last + 1], third[: last + 1], piece[: last + 1], left[: last + 1]
                    take = max(64, take // 2)
                else:
                    take = min(QUEUE_PLACES, take * 4)
                sym[places] = piece
                alive[second] = False
                after[places] = third
                before[third[third < n]] = places[third < n]
                changed = np.unique(np.concatenate([places, before[places][before[places] >= 0]]))
                beyond = after[changed]
                merged[changed] = np.where(beyond < n, self.table.find(sym[changed], sym[np.minimum(beyond, n - 1)]), -1)
                rank[changed] = self._ranks(merged[changed])
            else:
                take = min(QUEUE_PLACES, take * 4)
                changed = places
            if len(rest):
                lists[:] = [rest]
            else:
                del waiting[r]
                heapq.heappop(ranks)
            wait(changed)
        return sym[alive]

    def _merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word of the given numbers of symbols has, and the ids of all."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        ended_words, ended_symbols = [], []
        same = np.append(word[1:] == word[:-1], False)  # whether the next symbol is of the same word
        merged = np.full(len(symbols), -1, np.int32)  # what a symbol and its next one merge to
        near = np.flatnonzero(same)
        merged[near] = self.table.find(symbols[near], symbols[near + 1])
        while len(symbols):
            rank = np.where(merged >= 0, self.rank[merged], _NONE)
            first = np.flatnonzero(np.append(True, ~same[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            places = np.flatnonzero((rank == best) & (best < _NONE))
            if len(places):
                # of neighbouring places every other one, from the left
                begins = np.append(True, np.diff(places) > 1)
                begins[1:] |= word[places[1:]] != word[places[:-1]]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                owner = word[places]
                places = places[~self.single[merged[places]] | np.append(True, owner[1:] != owner[:-1])]
            symbols[places] = merged[places]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            done = best == _NONE
            ended = np.flatnonzero(done)
            if len(ended):
                ended_words.append(word[ended])
                ended_symbols.append(symbols[ended])
                keep[ended] = False
            same[places] = same[places + 1]
            moved = np.cumsum(keep)[places] - 1  # where the merged symbols come to stand
            symbols, word, same, merged = symbols[keep], word[keep], same[keep], merged[keep]
            if len(moved):
                again = np.concatenate([moved, moved[(moved > 0)] - 1])
                merged[again] = -1
                again = again[same[again]]
                merged[again] = self.table.find(symbols[again], symbols[again + 1])
        word, symbols = np.concatenate(ended_words), np.concatenate(ended_symbols)
        order = np.argsort(word, kind="stable")
        word, symbols = self._ids_of(word[order], symbols[order])
        return np.bincount(word, minlength=len(lengths)), symbols

    def _ids_of(self, word: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, each with its word's number; a character without a piece becomes its bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if len(odd):
            raw = [(chr(-1 - s) if s < 0 else self.char_of[s]).encode() for s in symbols[odd].tolist()]
            times, unknown = np.ones(len(symbols), np.int64), np.zeros(len(symbols), bool)
            times[odd], unknown[odd] = [len(r) for r in raw], True
            where = np.repeat(unknown, times)
            word, symbols = np.repeat(word, times), np.repeat(symbols, times)
            symbols[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return word, symbols

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part of a cut has, and the ids of all."""
        return self.merge([w if w[0] in self._AS_IS else SPACE + w for w in words])

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        plain = pc.replace_substring(texts, "\n", " \n")
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(plain, f"^ |  | $|{SPACE}"))).tolist()
        if odd:  # rows with more than single spaces between words: cut one by one
            listed = plain.to_pylist()
            for i in odd:
                listed[i] = " ".join(self.cut(texts[i].as_py()))
            plain = pa.array(listed, plain.type)
        return self.cache.ids(plain)

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, with all spaces."""
        sizes = self.surface_size[ids]
        ends = np.cumsum(sizes)
        return self.surface[np.repeat(self.surface_at[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; the space put in front is taken off again."""
        return self.decode_flat(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace").removeprefix(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, sizes = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []

    def encode_listed(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text the number of its ids, the ids in decimal, comma-joined, and the bytes that they decode to."""
        ids, sizes = self.encode_flat(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        wide = self.id_text[ids]
        listed = wide[wide > 0].tobytes()
        at = np.concatenate([[0], np.cumsum(self.id_text_size[ids])])[ends].tolist()
        back = self.decode_flat(ids).tobytes()
        from_ = np.concatenate([[0], np.cumsum(self.surface_size[ids])])[ends].tolist()
        for n, a, b, c, d in zip(sizes.tolist(), at, at[1:], from_, from_[1:]):
            yield n, listed[a : max(a, b - 1)], back[c + 1 : d]


@functools.lru_cache(maxsize=2)
def load(model_path: str) -> PieceBpe:
    """The codec of a model file, once for each process."""
    return PieceBpe(model_path)


def _mapped(docs: DataFrame, model_path: str, text: str, added: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    names = [name for name, _, _ in added]
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, t) for n, t, _ in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        for whole in batches:
            for batch in pieces(whole, text, BATCH_BYTES):
                texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
                columns = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(make(codec, texts), added)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *columns], [*keep, *names])

    return docs.select(*keep).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids.  A null or empty text has no ids; texts are encoded whole, however long.

    Rows are independent of each other: repeated rows give repeated results, an
    empty table an empty one; a column already called ``ids`` is replaced.
    """

    def make(codec: PieceBpe, texts: pa.Array):
        flat, sizes = codec.encode_flat(texts)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))]

    return _mapped(docs, model_path, text, [(ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], make)


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with a string column: the text of each row's ids; null ids give an empty text."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [codec.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(texts, pa.string())], [*keep, text])

    return df.select(*keep).mapInArrow(run, schema)


def encoding_report(docs: DataFrame, model_path: str) -> DataFrame:
    """One row for each document: its number of ids, and digests of the ids and of the text that they decode to.

    A null text counts as empty, which has no ids; null ids stay; repeated rows
    give repeated rows, an empty table an empty one; texts are encoded whole,
    however long; other columns, whatever their names, aren't read.
    """

    def make(codec: PieceBpe, texts: pa.Array):
        rows = [(n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) for n, ids, back in codec.encode_listed(texts)]
        return list(zip(*rows))

    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _mapped(docs.select("doc_id", "text"), model_path, "text", added, make).select("doc_id", *[n for n, _, _ in added])
