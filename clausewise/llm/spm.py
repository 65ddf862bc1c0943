"""Operator 5: SentencePiece encoding and decoding.

Encoding: an Aho-Corasick automaton over the model's pieces runs once over the
normalised text; at each position its output links name every piece that ends
there, and each relaxes the best score of that position (single-pass Viterbi:
the segmentation with the largest sum of piece scores; ties go to the longer last
piece).  A character that no piece covers costs the lowest score less 10 and is
spelled in byte pieces, or is <unk> if the model has none.

No piece of the usual models holds the space mark after another character, so
texts are cut before each run of marks and the segmentation of a repeated word
is kept; a model with such pieces is run over whole texts.

Normalisation is the model's: leading mark (add_dummy_prefix), spaces as marks,
other rules by the library's normaliser.  Decoding joins the pieces' bytes, turns
marks into spaces and drops the leading one.  With an identity normaliser
decode(encode(text)) == text, except that the mark U+2581 itself comes back as a space.

The scores are the model file's.  For a BPE model these are merge ranks: the
best-score path is then not the library's merge order (see the README).

Edge cases: null text gives null ids, zero counts and a null round_trip;
empty text gives no ids and round trips; texts of any length are encoded whole;
rows are independent, so ties, repeats and empty tables need no rule; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import sys
import types
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import table, text_slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEEP = 500_000  # words whose segmentation a worker process keeps (about 120 MB)


def load_model(path: str = MODEL) -> dict:
    """Pieces, scores, kinds and normaliser settings of a model file (read on
    the driver; a few hundred KB, shipped with the tasks)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    probe = sp.normalize("  a  b ")
    return {
        "pieces": [sp.id_to_piece(i) for i in range(n)],
        "scores": [sp.get_score(i) for i in range(n)],
        "kinds": ["control" if sp.is_control(i) else "unk" if sp.is_unknown(i) else "byte" if sp.is_byte(i)
                  else "unused" if sp.is_unused(i) else "normal" for i in range(n)],
        "prefix": sp.normalize("a").startswith(MARK),
        "keeps_spaces": probe.endswith(f"a{MARK}{MARK}b{MARK}"),
        "identity": sp.normalize("ﬁ É́\t　").lstrip(MARK) == "ﬁ É́\t　".replace(" ", MARK),
        "path": path,
    }


class Codec:
    """Encoder and decoder of one model, with the words segmented so far."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}
        self.automaton = ahocorasick.Automaton()
        low, inner = 0.0, False
        for i, (piece, score, kind) in enumerate(zip(model["pieces"], model["scores"], model["kinds"], strict=True)):
            if kind == "normal" and piece:
                self.automaton.add_word(piece, (i, len(piece), score))
                low, inner = min(low, score), inner or MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.unknown = low - 10.0
        self.unk = model["kinds"].index("unk") if "unk" in model["kinds"] else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k == "byte"}
        self.cut = re.compile(r"[\s\S]+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        surface = [p.replace(MARK, " ").encode() for p in model["pieces"]]
        for i, kind in enumerate(model["kinds"]):
            if kind == "byte":
                surface[i] = bytes([int(model["pieces"][i][3:5], 16)])
            elif kind == "control":
                surface[i] = b""
            elif kind == "unk":
                surface[i] = " ⁇ ".encode()
        self.surface = surface
        self.sp = None

    def normalise(self, text: str) -> str:
        if not (self.model["identity"] and self.model["keeps_spaces"]):
            if self.sp is None:
                import sentencepiece
                self.sp = sentencepiece.SentencePieceProcessor(model_file=self.model["path"])
            return self.sp.normalize(text)
        return (MARK if self.model["prefix"] and text else "") + text.replace(" ", MARK)

    def segment(self, word: str) -> list[int]:
        """Viterbi over one stretch: ids of the best path."""
        n, unknown = len(word), self.unknown
        score, size, last = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1)  # last -1: the character is spelled
        done = 0  # positions up to here are final
        for end, (piece, length, value) in self.automaton.iter(word):
            while done < end:  # a position is also reached by spelling a character
                spelled = score[done] + unknown
                done += 1
                if spelled > score[done]:
                    score[done], size[done], last[done] = spelled, 1, -1
            stop = end + 1
            reached = score[stop - length] + value
            held = score[stop]
            if reached > held or (reached == held and length > size[stop]):
                score[stop], size[stop], last[stop] = reached, length, piece
        while done < n:
            spelled = score[done] + unknown
            done += 1
            if spelled > score[done]:
                score[done], size[done], last[done] = spelled, 1, -1
        out: list[int] = []
        at = n
        while at > 0:
            if last[at] < 0:
                raw = word[at - 1].encode("utf-8", "surrogatepass")
                out.extend([self.bytes[x] for x in reversed(raw)] if len(self.bytes) == 256 else [self.unk])
                at -= 1
            else:
                out.append(last[at])
                at -= size[at]
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        ids = self.segment(word)
        got = struct.pack(f"={len(ids)}i", *ids)
        if len(word) <= 64:
            if len(self.known) >= KEEP:
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        known, parts = self.known, []
        for word in self.cut.findall(self.normalise(text)):
            got = known.get(word)
            parts.append(self.__missing__(word) if got is None else got)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.model["prefix"] and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def shared_codec(model: dict) -> Codec:
    """The codec of a worker process: its tasks, one after another, share the
    segmented words."""
    held = sys.modules.setdefault("clausewise_codecs", types.ModuleType("clausewise_codecs")).__dict__
    key = repr((model["path"], len(model["pieces"]), sum(model["scores"])))
    if key not in held:
        held[key] = Codec(model)
    return held[key]


def _id_lists(parts: list[np.ndarray | None]) -> pa.Array:
    size = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([0 if p is None else len(p) for p in parts], out=size[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *[p for p in parts if p is not None]])
    return pa.ListArray.from_arrays(pa.array(size), pa.array(flat), mask=pa.array([p is None for p in parts]))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """doc_id, ids array<int>, n_pieces, n_spelled (byte or unknown pieces),
    round_trip (decoding gives the text back)."""
    model = load_model(model_path)
    kinds = model["kinds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model)
        spelled = np.array([k in ("byte", "unk") for k in kinds])
        for batch in batches:
            for a, b, _, _ in text_slices(batch.column(1)):
                ids, n, odd, same = [], [], [], []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    got = None if text is None else codec.encode(text)
                    ids.append(got)
                    n.append(0 if got is None else len(got))
                    odd.append(0 if got is None else int(spelled[got].sum()))
                    same.append(None if got is None else codec.decode(got) == text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), _id_lists(ids), pa.array(n, pa.int64()), pa.array(odd, pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_pieces", "n_spelled", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_spelled long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give null text."""
    model = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model)
        for batch in batches:
            text = [None if ids is None else codec.decode(np.asarray(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
