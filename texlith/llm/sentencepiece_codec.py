"""SentencePiece models on the tokenizers library: encoding and decoding without the sentencepiece runtime.

The model file (a protobuf) is parsed field by field; normaliser, meta-space marker, pieces with scores and byte
fallback are rebuilt as a tokenizers pipeline, for unigram and BPE models. Batches are encoded by the library's threads.
Parity with the sentencepiece library can be verified row by row.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from texlith.llm._common import as_texts, slices

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Piece types of the model format (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Spec(NamedTuple):
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: str
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool


def parse_model(data: bytes) -> Spec:
    """Reads a model file: pieces (1), trainer (2) and normaliser (3) settings."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
        elif number in (2, 3):
            (trainer if number == 2 else normalizer).update(_fields(value))
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
    if kind is None:
        raise ValueError("only unigram and BPE models are supported")
    unk = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
    return Spec(pieces, kind, bool(trainer.get(35, 0)), unk, normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    score = {p: s for p, s, t in spec.pieces if t in (_NORMAL, _USER, _UNUSED)}
    place = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    out = []
    for piece, s in score.items():
        halves = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
        out += [(-s, place[a], place[b], a, b) for a, b in halves]
    return [x[3:] for x in sorted(out)]


def cuts_at_marks(spec: Spec) -> bool:
    """Whether no piece reaches over the start of a run of markers, so that texts may be cut there without a change."""
    return spec.escape and spec.kind == "bpe" and not any(MARK in p.lstrip(MARK) for p, _, t in spec.pieces if t != _CONTROL) and not any(t == _USER for _, _, t in spec.pieces)


def build(spec: Spec, bare: bool = False):
    """A tokenizers.Tokenizer that encodes and decodes as the model does; `bare`: for text that is normalised already."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = spec.pieces[spec.unk_id][0]
    if spec.kind == "bpe":
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges_of(spec), unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0 if bare else 200_000)
    else:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk_id, spec.byte_fallback)
    out = Tokenizer(model)
    space = MARK if spec.escape else " "
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(space))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if not bare:
        out.normalizer = normalizers.Sequence(steps)
    if not bare and cuts_at_marks(spec):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    users = [p for p, _, t in spec.pieces if t == _USER]
    if users:
        out.add_tokens([AddedToken(p, normalized=False) for p in users])
    tail = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Codec:
    """A rebuilt model that looks up equal words: distinct ones of a slice go to the library as one batch."""

    def __init__(self, data: bytes, remembered: int = 600_000):
        self.spec = parse_model(data)
        self.bare = build(self.spec, bare=True)
        self.words = cuts_at_marks(self.spec)
        self.plain = not self.spec.charsmap and not self.spec.squeeze
        self.remembered, self.held = remembered, {}
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if t == _BYTE else p.replace(MARK, " ").encode() for p, _, t in self.spec.pieces]

    @cached_property
    def whole(self):
        return build(self.spec)

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.whole.normalizer.normalize_str(text)
        return (MARK * (self.spec.dummy_prefix and text != "") + text).replace(" ", MARK)

    def _add(self, words: list[str]) -> None:
        ids = [e.ids for e in self.bare.encode_batch_fast(words, add_special_tokens=False)]
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        self.held.update(zip(words, (data[i:k] for i, k in zip([0, *ends], ends, strict=False)), strict=True))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if not self.words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        split = [_WORDS.findall(self.normalized(t)) for t in texts]
        distinct = set(chain.from_iterable(split))
        new = list(distinct - self.held.keys())
        if len(self.held) + len(new) > self.remembered:
            self.held = {}
            new = list(distinct)
        if new:
            self._add(new)
        return [b"".join(map(self.held.__getitem__, words)) for words in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_bytes(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids. Pieces' bytes are joined; where bytes that are no UTF-8 came in, the library decides what to make of them."""
        out = []
        for x in ids:
            try:
                text = b"".join(map(self.bytes_of.__getitem__, x)).decode()
            except UnicodeDecodeError:
                text = self.whole.decode(x, skip_special_tokens=False)
            else:
                text = text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text
            out.append(text)
        return out


@lru_cache(2)
def loaded(path: str) -> Codec:
    """One codec for each worker; its threads are as many as a task has cores."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    with open(path, "rb") as f:
        return Codec(f.read())


@lru_cache(2)
def _reference(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_and_decode(docs: DataFrame, path: str, verify: bool = True, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, parity for each row of docs(doc_id, text, ...); with `texts` also ids and decoded.

    ids_crc32 is of little-endian unsigned 32-bit ids; round_trip whether decoding the ids gives the text; parity whether
    sentencepiece gives the same ids (null unless `verify`). A null text is empty: 0 ids. One pass without a shuffle;
    repeated rows stay repeated; other columns aren't read; an empty table gives no rows.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = loaded(path)
        for batch in rows:
            given, out = as_texts(batch["text"]), []
            for a, b in slices([len(t) for t in given]):
                some = given[a:b]
                gc.disable()  # a slice makes millions of objects and no cycles
                try:
                    packed = codec.encode_bytes(some)
                    ids = [np.frombuffer(x, "<u4").tolist() for x in packed]
                    back = codec.decode(ids)
                    same = _reference(path).encode(some, num_threads=1) if verify else None
                    for i, x in enumerate(ids):
                        row = (len(x), zlib.crc32(packed[i]), back[i] == some[i], x == same[i] if verify else None)
                        out.append((*row, x, back[i]) if texts else row)
                finally:
                    gc.enable()
            made = pd.DataFrame(out, columns=names)
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made.astype({"doc_id": "Int64"})

    names = ["n_tokens", "ids_crc32", "round_trip", "parity"] + ["ids", "decoded"] * texts
    kind = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>, decoded string" * texts
    return docs.select("doc_id", "text").mapInPandas(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
