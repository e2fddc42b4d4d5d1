"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; its normaliser, white-space marker, pieces, scores and byte fallback
are rebuilt as a tokenizers pipeline, and batches are encoded by several threads. Both kinds of model are rebuilt:
unigram from the scores, BPE from merges derived from the scores. The public model at hand is of the BPE kind.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import table
from rtlake.llm.texts import kept_by_worker, map_texts

MARK = "▁"
#: Kinds of piece and of model in the protobuf (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of a batch, and characters of a batch.
THREADS, BATCH_CHARS = 2, 400_000
#: Words whose ids are remembered; words encoded in one run.
CACHE, RUN = 250_000, 500
_BYTE_TEXT = re.compile(r"<0x[0-9A-F]{2}>")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    mark_at_end: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else size
        if size is None:
            raise ValueError(f"wire type {key & 7} isn't used by SentencePiece models")
        yield key >> 3, raw[at : at + size]
        at += size


def parse(raw: bytes) -> Model:
    """The parts of a serialised model that encoding and decoding depend on."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback, model.mark_at_end = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap, model.dummy_prefix, model.squeeze, model.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    kinds = {kind for *_, kind in model.pieces}
    if model.kind not in (UNIGRAM, BPE) or kinds & {USER_DEFINED, UNUSED} or model.mark_at_end or not model.escape:
        raise NotImplementedError("only unigram and BPE models without user-defined or unused pieces, with a leading marker, are rebuilt")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Merges of a BPE model in order of rank.

    A piece can arise from each split of it into two pieces. The library merges the best score first and, among
    equal scores, the leftmost; where runs of one character tie, longest first comes to the same.
    """
    score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    ranked = sorted((p for p in score if len(p) > 1), key=lambda p: (-score[p], -len(p)))
    return [(p[:i], p[i:]) for p in ranked for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


def backend(model: Model):
    """A tokenizers pipeline that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    unknown = next((i for i, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    # No text may spell a control piece: such pieces get names of noncharacters.
    names = [p if kind in (NORMAL, BYTE) else f"￿{i}￿" for i, (p, _, kind) in enumerate(model.pieces)]
    if model.kind == BPE:
        inner = models.BPE({p: i for i, p in enumerate(names)}, merges(model), unk_token=None if unknown is None else names[unknown], byte_fallback=model.byte_fallback, fuse_unk=True)
    else:
        least = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        inner = models.Unigram([(n, s if kind == NORMAL else least) for n, (_, s, kind) in zip(names, model.pieces, strict=True)], unk_id=unknown, byte_fallback=model.byte_fallback)
    t = Tokenizer(inner)
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL):
        # No piece spans the start of a word, so words are encoded on their own, and repeated ones from a cache.
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return t


class Codec:
    """Encodes and decodes batches with ``threads`` threads; ``raw`` is the serialised model."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model, self.threads = parse(raw), threads
        self.backend = backend(self.model)
        self.by_word = self.model.kind == BPE and self.backend.pre_tokenizer is not None
        if self.by_word:  # texts are made normal and split first, so what reaches the backend is normal already
            from tokenizers import normalizers

            self._normalizer, self.backend.normalizer = self.backend.normalizer, normalizers.Sequence([])
            self._marked = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
            # A character that is in no piece, and falls back to a byte, merges with nothing: lines are apart as well.
            self._lines = self.model.byte_fallback and not any("\n" in p for p, *_ in self.model.pieces)
            #: Words whose ids are known, as rows; the place and number of each row's ids in one array.
            self._rows, self._ids = {}, np.zeros(0, np.int32)
            self._starts, self._lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=raw)
        #: What each piece stands for in a text, in UTF-8; of pieces that stand for none, a byte that no text holds.
        spelt = [p.replace(MARK, " ").encode() if kind == NORMAL else bytes([int(p[3:5], 16)]) if kind == BYTE else b"\xff" for p, _, kind in self.model.pieces]
        self._spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self._spelt_lengths = np.fromiter(map(len, spelt), np.int64)
        self._spelt_starts = np.cumsum(self._spelt_lengths) - self._spelt_lengths

    def _learn(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Encodes words (blanks stand for markers): the words in another order, each one's number of ids, and all ids in a row."""
        # Words with one marker are encoded in long runs: in the ids, a word begins where a piece begins with the marker.
        single = [w for w in words if w[0] == " " and w[1:2] not in ("", " ")]
        rest = [w for w in words if not (w[0] == " " and w[1:2] not in ("", " "))]
        runs = ["".join(single[i : i + RUN]).replace(" ", MARK) for i in range(0, len(single), RUN)]
        run_ids = [x.ids for x in self.backend.encode_batch_fast(runs, add_special_tokens=False)]
        rest_ids = [x.ids for x in self.backend.encode_batch_fast([w.replace(" ", MARK) for w in rest], add_special_tokens=False)]
        first = np.fromiter(chain.from_iterable(run_ids), np.int32)
        begins = np.flatnonzero(self._marked[first])
        lengths = np.concatenate([np.diff(begins, append=len(first)), np.fromiter(map(len, rest_ids), np.int64)]).astype(np.int64)
        if len(lengths) != len(words):
            raise ValueError("a piece with a marker lies within a word")
        return single + rest, lengths, np.concatenate([first, np.fromiter(chain.from_iterable(rest_ids), np.int32)])

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; each new word is encoded once.

        Words are independent, as no piece spans the start of one, so ids of a text are those of its words.
        """
        if self.model.charsmap or self.model.squeeze or not self.model.dummy_prefix:
            normal = pa.array([self._normalizer.normalize_str(t).replace(MARK, " ") for t in texts.to_pylist()], pa.string())
        else:
            texts = pa.compute.replace_substring(texts, MARK, " ")
            normal = pa.compute.if_else(pa.compute.equal(texts, ""), "", pa.compute.binary_join_element_wise("", texts, " "))
        offsets = np.frombuffer(normal.buffers()[1], np.int32)[normal.offset : normal.offset + len(normal) + 1]
        raw = np.frombuffer(normal.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = np.concatenate([[False], raw == 32])
        starts = blank[1:] & ~blank[:-1]
        if self._lines:
            line = np.concatenate([[False], raw == 10])
            starts |= line[1:] != line[:-1]
        starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(starts)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw.tobytes())).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found, new = self._rows, [w for w in distinct if w not in self._rows]
        all_ids, all_starts, all_lengths = self._ids, self._starts, self._lengths
        if new:
            new, lengths, ids = self._learn(new)
            all_starts = np.concatenate([all_starts, len(all_ids) + np.cumsum(lengths) - lengths])
            all_ids, all_lengths, n = np.concatenate([all_ids, ids]), np.concatenate([all_lengths, lengths]), len(found)
            if n + len(new) <= CACHE:  # what comes first is common; once full, other words are encoded batch by batch
                self._rows.update(zip(new, range(n, n + len(new)), strict=True))
                self._ids, self._starts, self._lengths = all_ids, all_starts, all_lengths
            else:
                other = dict(zip(new, range(n, n + len(new)), strict=True))
                found = {w: self._rows[w] if w in self._rows else other[w] for w in distinct}
        rows = np.fromiter(map(found.__getitem__, distinct), np.int64)[words.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        lengths = all_lengths[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = all_ids[np.repeat(all_starts[rows] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of texts (none of them null) as list<int32>."""
        if self.by_word:
            ids, offsets = self._by_word(texts)
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        texts = texts.to_pylist()
        found = [x.ids for x in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        if self.model.kind == UNIGRAM and self.model.byte_fallback:  # a unigram lattice would read a spelt-out byte piece as that byte
            for i, t in enumerate(texts):
                if _BYTE_TEXT.search(t):
                    found[i] = self.original.encode(t)
        return pa.array(found, pa.list_(pa.int32()))

    def decode(self, ids: list) -> list[str]:
        return self.backend.decode_batch(ids, skip_special_tokens=False)

    def _bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 that pieces stand for, one after another."""
        lengths = self._spelt_lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self._spelt[np.repeat(self._spelt_starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()

    def exact(self, texts: pa.Array, ids: pa.ListArray) -> list[bool]:
        """Whether decoding gives each text (none of them null) back.

        Where a text is what its pieces stand for, but for the prefix, decoding gives just that; all others are decoded.
        """
        flat, ends, raw = ids.values.to_numpy(), ids.offsets.to_pylist(), texts.cast(pa.binary()).to_pylist()
        prefix = b" " if self.model.dummy_prefix else b""
        found = [self._bytes(flat[a:b]).removeprefix(prefix) == t for t, (a, b) in zip(raw, pairwise(ends), strict=True)]
        other = [i for i, same in enumerate(found) if not same]
        for i, t in zip(other, self.decode([flat[ends[i] : ends[i + 1]].tolist() for i in other]), strict=True):
            found[i] = t.encode() == raw[i]
        return found

    def parity(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library that owns the format gives the same ids."""
        return [a == b for a, b in zip(self.original.encode(texts, num_threads=self.threads), ids, strict=True)]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes | None = None, threads: int = THREADS, verify: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, token_ids, n_tokens, exact, parity, and unless told otherwise decoded: one row per row of ``docs``.

    exact: whether decoding gives the text back. parity: whether the original library gives the same ids for the whole
    text (null unless ``verify``). Null text: as the empty text, no ids. Rows that repeat are encoded alike. Very long
    texts make batches of their own. Empty table: no rows. Other columns, whatever their names, aren't read. The model
    (bounded: one file) is read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model or default_model(), threads))

    def body(parts: Iterator) -> Iterator[dict]:
        codec = kept_by_worker(("codec", hash(shared.value)), lambda: Codec(*shared.value))
        for p in parts:
            column = pa.compute.fill_null(p.column("text"), "")
            ids, texts = codec.encode_array(column), column.to_numpy(zero_copy_only=False).tolist()
            flat, ends = ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
            rows = [flat[a:b] for a, b in pairwise(ends)]
            out = {"doc_id": p.column("doc_id"), "token_ids": ids, "parity": codec.parity(texts, rows) if verify else [None] * len(texts)}
            if decoded:
                back = codec.decode(rows)
                yield out | {"decoded": back, "exact": [a == b for a, b in zip(texts, back, strict=True)]}
            else:
                yield out | {"exact": codec.exact(column, ids)}

    schema = "doc_id long, token_ids array<int>, exact boolean, parity boolean" + ", decoded string" * decoded
    out = map_texts(docs.select("doc_id", "text"), schema, body, BATCH_CHARS)
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, whether they decode to it, and whether the original library gives the same."""
    return encode(table(spark, sf_dir, "documents"), decoded=False).select("doc_id", "n_tokens", "token_ids", "exact", "parity")
