"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words: a run of ``▁`` (the escaped space) and the
characters up to the next run.  No piece of a model accepted here holds a
``▁`` after another character, so no merge crosses a word and words encode on
their own.  Words not seen yet go into one flat numpy symbol array; each round
finds every adjacent pair's rank, the minimum per word by a segmented
reduction, merges the leftmost occurrences of it in all words at once and
compacts the array, until no pair has a rank.

Merging every occurrence in one round equals the library's one-at-a-time order
unless the merged piece starts a pair of equal or better rank; for such pieces
only the leftmost occurrence of a word is merged in a round.

Defined results: null and empty texts encode to the end id alone and decode to
the empty string; repeated rows are encoded each; other columns are untouched.
Memory is bounded by the batch slice and by the bounded word cache."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlytics.llm.word_cache import WordCache, from_bytes, list_array, slices, to_bytes

SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max
#: Words of more symbols than this use an agenda of merges, one at a time.
LONG_WORD = 4096


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            if kind == 2:
                n, at = _varint(buf, at)
            else:
                n = 8 if kind == 1 else 4
            value, at = buf[at:at + n], at + n
        yield key >> 3, value


class PieceModel:
    """Pieces, ranks and pair table of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece  # reads the model file only
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._check(sp)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int32)
        self.is_byte = np.zeros(n, bool)
        normal, score = [], {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                normal.append(i)
                score[i] = sp.get_score(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a space after another character")
        self.eos = sp.eos_id()
        self.unk = sp.unk_id()
        self.control = {i for i in range(n) if sp.is_control(i)}
        # equal scores share a rank: the library then takes the leftmost
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(n, NO_RANK, np.int32)
        for i in normal:
            self.rank[i] = order[score[i]]
        ids = {self.pieces[i]: i for i in normal}
        self.char_id = {p: i for p, i in ids.items() if len(p) == 1}
        self._pairs(ids)
        # decoding: bytes of each id with spaces restored
        self.surface = [b"" if i in self.control else bytes([int(p[3:5], 16)]) if self.is_byte[i]
                        else " ⁇ ".encode() if i == self.unk else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(self.pieces)]

    @staticmethod
    def _check(sp) -> None:
        for number, value in _fields(sp.serialized_model_proto()):
            if number == 2 and dict(_fields(value)).get(3) != 2:
                raise ValueError("not a BPE model")
            if number == 3:
                spec = dict(_fields(value))
                if spec.get(2, b"") or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only identity normalisation with a leading space is supported")

    def _pairs(self, ids: dict[str, int]) -> None:
        """Open-addressing table of mergeable (left, right) -> merged id."""
        left, right, made = [], [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        # pieces that can begin or end a pair of equal or better rank
        self.one_at_a_time = np.zeros(len(self.rank), bool)
        for part in (left, right):
            self.one_at_a_time[part[self.rank[made] <= self.rank[part]]] = True
        self.base = len(self.rank)
        size = 1 << int(np.ceil(np.log2(max(4, 4 * len(left)))))
        self.mask = size - 1
        self.table_key = np.full(size, -1, np.int64)
        self.table_id = np.zeros(size, np.int32)
        key = left * self.base + right
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.table_key[slot[todo]] == -1]
            self.table_key[slot[free]] = key[free]          # one of equal slots wins
            won = self.table_key[slot[todo]] == key[todo]
            self.table_id[slot[todo[won]]] = made[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x9E3779B97F4A7)) >> np.int64(17)) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's merge, -1 where there is none."""
        key = left.astype(np.int64) * self.base + right
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        live = np.arange(len(key))
        for _ in range(self.probes):
            at = slot[live]
            found = self.table_key[at]
            hit = found == key[live]
            out[live[hit]] = self.table_id[at[hit]]
            live = live[~hit & (found != -1)]
            if not len(live):
                break
            slot[live] = (slot[live] + 1) & self.mask
        return out

    # -- encoding ---------------------------------------------------------
    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words' characters (-1: not a piece) and each word's length."""
        joined = "".join(words)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        uniq, where = np.unique(code, return_inverse=True)
        table = np.array([self.char_id.get(chr(c), -1 - int(c)) for c in uniq], np.int64)
        return table[where], np.fromiter(map(len, words), np.int64, len(words))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Piece ids of each word (escaped text), by merge rounds, as bytes."""
        if not words:
            return []
        sym, lengths = self._symbols(words)
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        if (lengths > LONG_WORD).any():
            long = np.flatnonzero(lengths > LONG_WORD)
            starts = np.cumsum(lengths) - lengths
            for w in long:
                out = self._agenda(sym[starts[w]:starts[w] + lengths[w]])
                done_sym.append(out)
                done_word.append(np.full(len(out), w))
            keep = ~np.isin(word, long)
            sym, word = sym[keep], word[keep]
        while len(sym):
            # rank of each symbol with its right neighbour in the same word
            made = np.full(len(sym), -1, np.int32)
            inner = np.flatnonzero((word[1:] == word[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
            made[inner] = self.merged(sym[inner], sym[inner + 1])
            rank = np.where(made >= 0, self.rank[np.maximum(made, 0)], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            over = best == NO_RANK
            if over.any():                                   # these words are finished
                gone = np.repeat(over, counts)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                keep = ~gone
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                best, counts = best[~over], counts[~over]
                if not len(sym):
                    break
            pick = self._leftmost(np.flatnonzero(rank == np.repeat(best, counts)), word, made)
            sym[pick] = made[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], len(words))

    def _leftmost(self, at: np.ndarray, word: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Non-overlapping merges to make now among the best pairs: of a run of
        overlapping candidates every second one, from the left; where a word's
        candidates differ or its piece may be consumed again, the first only."""
        new_word = np.r_[True, word[at][1:] != word[at][:-1]]
        run = new_word | np.r_[True, np.diff(at) > 1]
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        pick = (np.arange(len(at)) - first) % 2 == 0
        heads = np.flatnonzero(new_word)
        sizes = np.diff(np.r_[heads, len(at)])
        ids = made[at]
        single = self.one_at_a_time[ids] | (ids != np.repeat(ids[heads], sizes))
        alone = np.logical_or.reduceat(single, heads)
        pick &= ~np.repeat(alone, sizes)
        pick[heads] = True
        return at[pick]

    def _agenda(self, sym: np.ndarray) -> np.ndarray:
        """Merges of one long word in rank order, leftmost first."""
        sym = sym.tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        memo: dict[tuple[int, int], int] = {}

        def made(a: int, b: int) -> int:
            if a < 0 or b < 0:
                return -1
            if (a, b) not in memo:
                memo[a, b] = int(self.merged(np.array([a]), np.array([b]))[0])
            return memo[a, b]

        heap = [(int(self.rank[m]), i, sym[i], sym[i + 1], m) for i in range(n - 1) if (m := made(sym[i], sym[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = m, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (q := made(sym[x], sym[after[x]])) >= 0:
                    heapq.heappush(heap, (int(self.rank[q]), x, sym[x], sym[after[x]], q))
        return np.array([s for s, ok in zip(sym, alive, strict=True) if ok], np.int64)

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """Replace characters outside the vocabulary by byte pieces; split by word."""
        if (sym < 0).any():
            reps = np.ones(len(sym), np.int64)
            unknown = np.flatnonzero(sym < 0)
            raw = [self.byte_ids[list(chr(-1 - int(c)).encode())] for c in sym[unknown]]
            reps[unknown] = [len(r) for r in raw]
            out, word = np.repeat(sym, reps), np.repeat(word, reps)
            out[np.repeat(sym < 0, reps)] = np.concatenate(raw)
            sym = out
        raw = sym.astype("<i4").tobytes()
        ends = (4 * np.searchsorted(word, np.arange(1, n + 1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids, as the library's ``decode``: control ids
        vanish (and end a run of byte pieces), and the leading space that
        encoding adds goes."""
        if not self.control.isdisjoint(ids[:-1]):
            runs, run = [], []
            for i in ids:
                if i in self.control:
                    runs.append(run)
                    run = []
                else:
                    run.append(i)
            runs = [r for r in [*runs, run] if r]
        else:
            runs = [ids] if ids and ids[0] not in self.control else []
        texts = []
        for run in runs:
            raw = b"".join(map(self.surface.__getitem__, run))
            if not texts and not self.is_byte[run[0]] and run[0] != self.unk and raw.startswith(b" "):
                raw = raw[1:]
            try:
                texts.append(raw.decode())
            except UnicodeDecodeError:                       # one mark for each stray byte
                texts.append(_mark_stray(raw))
        return "".join(texts)


def _mark_stray(raw: bytes) -> str:
    """Decode with one replacement mark for each byte that is not UTF-8."""
    text = raw.decode("utf-8", "surrogateescape")
    return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text)


@functools.lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


@functools.lru_cache(maxsize=4)
def load_encoder(path: str, add_eos: bool) -> Encoder:
    """One encoder a worker process: its word cache serves all its tasks."""
    return Encoder(load_model(path), add_eos)


class Encoder:
    """Encodes texts with a bounded cache of word -> ids."""

    def __init__(self, model: PieceModel, add_eos: bool = True):
        self.model, self.tail = model, to_bytes([model.eos]) if add_eos else b""
        self.cache = WordCache(lambda words: model.encode_words([SPACE + w.replace(" ", SPACE) for w in words]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        return self.cache.documents([self.words(t) if t else [] for t in texts], self.tail)

    @staticmethod
    def words(text: str) -> list[str]:
        """Words of a text without their leading space; of a run of spaces all
        but the first stay in front of what follows."""
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        out, run = [], ""
        for p in parts:
            if p:
                out.append(run + p)
                run = ""
            else:
                run += " "
        return out + [run[1:]] if run else out


def _model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers
        return public_tokenizers.path("piece_bpe_32k.model")
    return path


def encode_decode(df: DataFrame, *, text: str = "text", keep: list[str] | None = None,
                  model_path: str | None = None, add_eos: bool = True, decode: bool = True) -> DataFrame:
    """``keep`` columns (default: all), ``ids`` array<int> and, with ``decode``,
    ``decoded`` string.  One pass over the input, no shuffle.  The output
    columns replace input columns of the same name."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "decoded")]
    carried = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__sp_text"))
    out = T.StructType([f for f in carried.schema.fields if f.name != "__sp_text"]
                       + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
                       + ([T.StructField("decoded", T.StringType())] if decode else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(_model_path(model_path), add_eos)
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                ids = encoder.encode(part.column(last).to_pylist())
                arrays = part.columns[:last] + [list_array(ids)]
                if decode:
                    arrays.append(pa.array([encoder.model.decode(from_bytes(i).tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    return carried.mapInArrow(run, out)


def decode_ids(df: DataFrame, *, ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """Append ``decoded``: the text of an array<int> column (null: empty)."""
    out = T.StructType([f for f in df.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    names = [c for c in df.columns if c != "decoded"]

    def run(batches):
        model = load_model(_model_path(model_path))
        for batch in batches:
            rows = batch.column(names.index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array([model.decode(r or []) for r in rows], pa.string())],
                                             names=names + ["decoded"])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out)


def digests(encoded: DataFrame) -> DataFrame:
    """The per-document digest of :func:`encode_decode`'s real columns."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
