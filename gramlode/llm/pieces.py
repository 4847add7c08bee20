"""SentencePiece encoding and decoding with a Viterbi search whose forward scores are shared by prefixes.

A text is cut into marked words: runs of space marks followed by other characters. No piece of the
vocabulary may cross such a cut (checked when the model is read), so a text's pieces are those of
its words. The distinct words of a task's rows are sorted, which puts them in the depth-first order of
their trie: a word takes over the forward scores of the prefix it shares with the word before it,
and only the rest of it is searched.

Two model types, by the model file:

* unigram: the best sum of piece scores, unknown characters at the usual penalty;
* BPE: the merges decide. A sequence of pieces is what merging gives exactly if every two neighbours
  merge to themselves, so transitions between other neighbours score minus infinity. One path is
  left for each prefix, and the search finds it.

Characters that no piece covers become byte pieces (if the model has them) or the unknown piece.

Defined results: a null or empty text has no pieces and decodes to the empty string; rows are encoded one by
one; further columns pass through `encode` and `decode`, except one that is named like their result.
"""

from __future__ import annotations

import os
import re
import threading
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import session, tidy
from .words import slices

MARK = "▁"
#: Distinct words whose pieces a task keeps between its slices.
KEPT_WORDS = 500_000
#: Neighbours whose merging a task remembers.
KEPT_PAIRS = 400_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0


class Model:
    """Pieces, scores and normaliser settings of a SentencePiece model file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        kinds = pb.ModelProto.SentencePiece
        if proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and a mark before words are read")
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if not self.bpe and proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM:
            raise ValueError("only BPE and unigram models are read")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not read")
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.control = {k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.surface = proto.trainer_spec.unk_surface
        self.longest = max(map(len, self.ids))
        if crossing := [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        self.penalty = min((self.scores[k] for k in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self._pairs: dict[int, bool] = {}
        self.texts = list(self.pieces)  # by number; characters that no piece covers come after the pieces
        self.endings = self._suffix_table()

    # --- what BPE merging gives, for single pieces and pairs of them

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                got = self.ids.get(parts[k] + parts[k + 1])
                if got is not None and (best is None or self.scores[got] > best):
                    best, at = self.scores[got], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _suffix_table(self) -> dict[str, int]:
        """Every ending of a piece: its number if it is a piece that can be last (for BPE: merges to itself), or -1."""
        table: dict[str, int] = {}
        for piece, number in self.ids.items():
            if not self.bpe or self.merged(piece) == [piece]:
                table[piece] = number
            for k in range(1, len(piece)):
                table.setdefault(piece[k:], -1)
        return table

    def stand(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        if len(self._pairs) > KEPT_PAIRS:
            self._pairs.clear()
        a, b = self.texts[left], self.texts[right]
        found = self._pairs[left << 24 | right] = self.merged(a + b) == [a, b]
        return found

    def number(self, char: str) -> int:
        """The number of a single character, also of one that no piece covers."""
        found = self.endings.get(char, -1)
        if found < 0:
            found = self.ids.get(char, -1)
            if found < 0:
                if len(self.texts) > len(self.pieces) + KEPT_PAIRS:
                    return self._alone(char)
                found = len(self.texts)
                self.texts.append(char)
            self.endings[char] = found
        return found

    def _alone(self, char: str) -> int:
        """A number for one more uncovered character when very many are held; all of them behave alike."""
        self.texts[-1] = char
        return len(self.texts) - 1

    # --- text to words and back

    def marked(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def out(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Piece ids (int32) of sorted distinct words: one depth-first walk over their trie."""
        out, before, top = [], "", len(self.pieces)
        # forward state by prefix length: where the last piece of the best path starts, its number, the score
        begin: list[int] = [0]
        last: list[int] = [0]
        score: list[float] = [0.0]
        step = self._extend_bpe if self.bpe else self._extend_unigram
        commonprefix = os.path.commonprefix
        for word in words:
            shared = len(commonprefix((before, word)))
            del begin[shared + 1 :], last[shared + 1 :], score[shared + 1 :]
            step(word, shared + 1, begin, last, score)
            path, at = [], len(word)
            while at:
                path.append(at)
                at = begin[at]
            ids: list[int] = []
            for at in reversed(path):
                if last[at] < top:
                    ids.append(last[at])
                else:
                    ids += self.out(word[begin[at] : at])
            out.append(pack(f"{len(ids)}i", *ids))
            before = word
        return out

    def _extend_bpe(self, word: str, at: int, begin: list[int], last: list[int], score: list[float]) -> None:
        endings, pairs, scores, top = self.endings, self._pairs, self.scores, len(self.pieces)
        for end in range(at, len(word) + 1):
            start = end - 1
            number = self.number(word[start])
            while True:
                if number >= 0:
                    if not start:
                        break
                    stands = pairs.get(last[start] << 24 | number)
                    if stands or stands is None and self.stand(last[start], number):
                        break
                start -= 1
                number = endings[word[start:end]]  # one path is always left, so this is never missing
            begin.append(start)
            last.append(number)
            score.append(score[start] + (scores[number] if number < top else self.penalty))

    def _extend_unigram(self, word: str, at: int, begin: list[int], last: list[int], score: list[float]) -> None:
        endings, scores, top = self.endings, self.scores, len(self.pieces)
        for end in range(at, len(word) + 1):
            start = end - 1
            chosen, number = start, self.number(word[start])
            best = score[start] + (scores[number] if number < top else self.penalty)
            while start:
                start -= 1
                found = endings.get(word[start:end])
                if found is None:
                    break
                if found >= 0 and (value := score[start] + scores[found]) > best:
                    best, chosen, number = value, start, found
            begin.append(chosen)
            last.append(number)
            score.append(best)

    def encode(self, texts: list[str], kept: dict[str, bytes] | None = None) -> list[np.ndarray]:
        """Ids of each text; `kept` holds words that are known already and is bounded by KEPT_WORDS."""
        kept = {} if kept is None else kept
        cut = [_WORD.findall(self.marked(t)) if t else [] for t in texts]
        fresh = sorted({w for words in cut for w in words}.difference(kept))
        if len(kept) + len(fresh) > KEPT_WORDS:
            kept.clear()
            fresh = sorted({w for words in cut for w in words})
        kept.update(zip(fresh, self.encode_words(fresh)))
        get = kept.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.int32) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; byte pieces are read as UTF-8, with U+FFFD for each byte that does not fit."""
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self._of_byte:
                raw.append(self._of_byte[i])
                continue
            if raw:
                parts.append(_utf8(bytes(raw)))
                raw.clear()
            parts.append(self.surface if i == self.unknown else "" if i in self.control else self.pieces[i])
        if raw:
            parts.append(_utf8(bytes(raw)))
        text = "".join(parts)
        if self.prefix and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")

    @property
    def _of_byte(self) -> dict[int, int]:
        found = self.__dict__.get("_byte")
        if found is None:
            found = self.__dict__["_byte"] = {k: b for b, k in self.bytes.items()}
        return found


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[str, Model] = {}
_LOCK = threading.Lock()


def load(path: str, data: bytes | None = None) -> Model:
    with _LOCK:
        if path not in _MODELS:
            _MODELS[path] = Model(data if data is not None else open(path, "rb").read())
        return _MODELS[path]


def default_model() -> str:
    """The 32,000-piece model of the public tokenizer files."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _add(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns.values()], names=[*keep, *columns])


def _ids_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *rows])))


def encode(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with an array of piece ids. The model is read on the driver and broadcast: its size does not follow the data."""
    spark = session(docs.sparkSession)
    path = model or default_model()
    data = spark.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        known, kept = load(path, data.value), {}
        for batch in slices(batches, text):
            yield _add(batch, {ids: _ids_array(known.encode(batch.column(text).to_pylist(), kept))})

    fields = [f for f in docs.schema.fields if f.name != ids]
    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the text of its piece ids; a null array gives an empty text."""
    spark = session(encoded.sparkSession)
    path = model or default_model()
    data = spark.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        known = load(path, data.value)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                yield _add(part, {text: pa.array([known.decode(x or []) for x in part.column(ids).to_pylist()], pa.string())})

    fields = [f for f in encoded.schema.fields if f.name != text]
    return encoded.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pieces, ids, n_chars_decoded, round_trip): encoding, decoding, and whether the text came back."""
    spark = session(docs.sparkSession)
    path = model or default_model()
    data = spark.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        known, kept = load(path, data.value), {}
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            rows = known.encode(texts, kept)
            back = [known.decode(r.tolist()) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([len(r) for r in rows], pa.int64()), _ids_array(rows), pa.array([len(b) for b in back], pa.int64()), pa.array([a == b for a, b in zip(back, texts)])],
                names=[key, "n_pieces", "ids", "n_chars_decoded", "round_trip"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, n_pieces long, ids array<int>, n_chars_decoded long, round_trip boolean")
