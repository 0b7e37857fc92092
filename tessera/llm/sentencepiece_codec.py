"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as a protobuf (a few wire types); from its pieces, scores and settings
the tokenizer is rebuilt: the normaliser (a compiled character map, if any), the
white-space marker, unigram scores or, for BPE models, the merges in the order
of the scores, and byte fallback. Batches are encoded by the library's own threads.

Units. If no piece continues past a marker, the text can be cut before each run of markers:
the ids of a text are those of its units in order, and so is the decoded text. A task encodes each
unit once and remembers a bounded number of them. Other models encode whole texts.

Parity. ``verify`` encodes each unit (or whole text) with the sentencepiece library as well and decodes
its ids; a text has parity and makes the round trip if all its units do. The registered
query does so for every document; the tests compare whole texts.

Defined results: null and empty texts have no ids and decode to the empty text; decoding
undoes encoding up to the model's own normalisation; repeated rows are encoded alike; an
empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

MARKER = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
MEMORY = 600_000
LEARN = 2_048
GROUP_CHARS = 1 << 20


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protobuf message: varints, 64-bit, bytes and floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at:at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at:at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {kind} in the model file")


class Model:
    """Pieces and settings of a model file (field numbers of the public format)."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in wire(data):
            if field == 1:
                p = dict(wire(value))
                self.pieces.append((p[1].decode("utf-8"), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire(value))
            elif field == 3:
                normaliser = dict(wire(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.character_map = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that form a piece, best score first."""
        ids = {p[0]: i for i, p in enumerate(self.pieces)}
        found = []
        for text, score, kind in self.pieces:
            if kind == NORMAL:
                for k in range(1, len(text)):
                    if (a := ids.get(text[:k])) is not None and (b := ids.get(text[k:])) is not None:
                        found.append((-score, a, b))
        return [(self.pieces[a][0], self.pieces[b][0]) for _, a, b in sorted(found)]

    def by_unit(self) -> bool:
        """No piece has a marker after another character."""
        return self.escape and not any(MARKER in p[0].lstrip(MARKER) for p in self.pieces)


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = m = Model(f.read())
        if m.kind == BPE:
            core = models.BPE(vocab={p[0]: i for i, p in enumerate(m.pieces)}, merges=m.merges(), unk_token=m.pieces[m.unknown][0],
                              fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            core = models.Unigram([(p[0], p[1]) for p in m.pieces], m.unknown, m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = []
        if m.character_map:
            steps.append(normalizers.Precompiled(m.character_map))
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        marks = [decoders.Replace(MARKER, " ")] if m.escape else []
        strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
        self.tokenizer.decoder = decoders.Sequence([*marks, decoders.ByteFallback(), decoders.Fuse(), *strip])
        self.units: dict[str, bytes] = {}  # unit -> its ids
        self.other_ids: set[str] = set()  # of these, units for which the reference has other ids
        self.other_text: set[str] = set()  # and units that decode to something else
        self.doubted: set[str] = set()  # units that differ only together: their documents are compared whole
        self.by_unit = m.by_unit()

    def prepared(self, text: str) -> str:
        """Normalised, with markers."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if not text:
            return text
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARKER) if self.model.escape else text

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str], reference=None) -> None:
        """Encodes new units and, with a reference, verifies them."""
        found = self._encode(units)
        self.units.update((u, np.array(x, dtype=np.int32).tobytes()) for u, x in zip(units, found))
        if reference is None:
            return
        # the units in one text: cutting it must not matter either; only if it does, unit by unit
        start = 1 if self.model.dummy_prefix else 0  # the dummy prefix gives the first unit its marker again
        plain, ids = "".join(units).replace(MARKER, " ")[start:], [i for x in found for i in x]
        if reference.encode(plain) != ids:
            guilty = {u for u, x in zip(units, found) if reference.encode(u.replace(MARKER, " ")[start:]) != x}
            self.other_ids |= guilty
            self.doubted.update(() if guilty else units)
        if self.decode([ids]) != [plain]:
            guilty = {u for u, x in zip(units, found) if self.decode([x]) != [u.replace(MARKER, " ")[start:]]}
            self.other_text |= guilty
            self.doubted.update(() if guilty else units)

    def forget(self) -> None:
        self.units, self.other_ids, self.other_text, self.doubted = {}, set(), set(), set()

    def cut(self, texts: list[str], reference=None) -> Iterator[list[str]]:
        """The units of each text, all of them learnt."""
        cut = [_units(self.prepared(t)) for t in texts]
        missing = {u for units in cut for u in units if u not in self.units}
        if missing:
            if len(self.units) + len(missing) > MEMORY:
                missing = {u for units in cut for u in units}
                self.forget()
            missing = sorted(missing)
            for lo in range(0, len(missing), LEARN):
                self.learn(missing[lo:lo + LEARN], reference)
        return iter(cut)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for lo, hi in _groups(texts):
            if self.by_unit:
                out += [np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32) for units in self.cut(texts[lo:hi])]
            else:
                out += [np.array(x, dtype=np.int32) for x in self._encode([self.prepared(t) for t in texts[lo:hi]])]
        return out

    def verified(self, texts: list[str], reference) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        for lo, hi in _groups(texts):
            part = texts[lo:hi]
            if not self.by_unit:
                ids = self.encode(part)
                same = [np.array_equal(a, b) for a, b in zip(ids, reference.encode(part, num_threads=1))]
                yield from zip(ids, same, [a == b for a, b in zip(self.decode(ids), part)])
                continue
            for text, units in zip(part, self.cut(part, reference)):
                ids = np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int32)
                if self.normaliser is not None or self.doubted and not self.doubted.isdisjoint(units):
                    # the reference gets the raw text, so that a difference in the normaliser shows
                    yield ids, reference.encode(text) == ids.tolist(), self.decode([ids]) == [text]
                    continue
                whole = MARKER not in text and (self.normaliser is None or self.normaliser.normalize_str(text) == text)
                yield ids, not self.other_ids or self.other_ids.isdisjoint(units), whole and (not self.other_text or self.other_text.isdisjoint(units))

    def decode(self, ids: list) -> list[str]:
        return self.tokenizer.decode_batch([list(x) for x in ids], skip_special_tokens=False)


def _units(text: str) -> list[str]:
    """``text`` cut before each run of markers."""
    parts = text.split(MARKER)
    out = [parts[0]] if parts[0] else []
    run = MARKER
    for p in parts[1:]:
        if p:
            out.append(run + p)
            run = MARKER
        else:
            run += MARKER
    if len(run) > 1:
        out.append(run[1:])
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_CODECS: dict[str, Codec] = {}
_PROCESSORS: dict = {}


def codec(path: str) -> Codec:
    """The worker's codec, built once."""
    if path not in _CODECS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _strings(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ids (array of int)."""
    def ids(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model)
        for column in series:
            texts = _strings(column)
            for lo, hi in _groups(texts):  # small batches out
                yield pd.Series(own.encode(texts[lo:hi]))
        own.forget()

    return docs.withColumn("ids", F.pandas_udf(ids, "array<int>")(F.col(text).cast("string")))


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded."""
    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series(codec(model).decode([np.zeros(0, np.int32) if x is None else np.asarray(x) for x in column]))

    return encoded.withColumn("decoded", texts(F.col(ids)))


def digests(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", verify: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (little-endian 32-bit ids), round_trip (decoding gives the text) and, if verified, parity."""
    @F.pandas_udf("n_ids long, ids_sha256 string, round_trip boolean, parity boolean")
    def check(column: pd.Series) -> pd.DataFrame:
        own, texts = codec(model), _strings(column)
        found = own.verified(texts, reference(model)) if verify else ((x, None, None) for x in own.encode(texts))
        rows = [(len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), back, same) for ids, same, back in found]
        return pd.DataFrame(rows, columns=["n_ids", "ids_sha256", "round_trip", "parity"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.select("doc_id", check("text").alias("c")).select("doc_id", "c.*")


def reference(path: str) -> sentencepiece.SentencePieceProcessor:
    """The sentencepiece library's own processor, for parity."""
    if path not in _PROCESSORS:
        _PROCESSORS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PROCESSORS[path]
