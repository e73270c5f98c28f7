"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the powers of two that add up to
n: as many of the longest length as fit, then the binary digits of the rest,
longest first.  Each piece is a sequence of its own, and pieces of one length
make a bucket, so a batch of a bucket has no padding and no sequence crosses
documents.

Tokens never cross ASCII white space, so a task encodes each distinct run of
other bytes once, remembers it for a while, and looks the rest up.  Where the
tokenizer lower-cases, so does the task before, and runs of letters alone, which
are one word each, are told apart by the tokenizer's word ends.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import plus

LONGEST, END_ID = 2048, 1
#: Signs between a letter (ASCII or Latin-1, in UTF-8) or digit and white space.
SIGNS = re.compile(
    rb"([!-/:-@\[-`{-~](?:(?<=[0-9A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*)(?=[\t-\r ]|\Z)"
)
#: A special token of the tokenizer.
MARK = "<|startoftext|>"
#: Runs a task remembers, and the bytes of text it looks up at once.
REMEMBERED, AT_ONCE = 500_000, 1 << 22


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to ``n``, none above ``longest`` (itself one), descending."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Encoder:
    """Token ids of texts, equal to those of the tokenizer on the whole text."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        definition = json.loads(tokenizer_json)
        self.lowers = '"Lowercase"' in json.dumps(definition.get("normalizer"))
        suffix = definition["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.mark_id = self.tokenizer.token_to_id(MARK)
        self.mark = f" {MARK} "
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.begins, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _learn(self, runs: list[bytes]) -> None:
        new = [r for r in dict.fromkeys(runs) if r not in self.codes]
        if len(self.codes) + len(new) > REMEMBERED and self.codes:
            self._forget()
            new = list(dict.fromkeys(runs))
        if not new:
            return
        new.sort(key=lambda r: not r.decode("utf-8", "replace").isalpha())  # letters alone, most runs, come first
        ids, lengths = self._encode(new)
        begins = len(self.ids) + np.cumsum(lengths) - lengths
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.begins, self.lengths = np.concatenate([self.begins, begins]), np.concatenate([self.lengths, lengths])

    def _encode(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All runs' ids in a row, and how many each has.

        Many runs are encoded as one text.  Between letters alone a space will
        do: the ids that end a word are counted, and if there are as many as
        runs, each run is one word.  Else a special token goes between them,
        which the tokenizer cuts out before it looks at the rest.
        """
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(runs), 250):
            some = [r.decode("utf-8", "replace") for r in runs[at : at + 250]]
            if all(map(str.isalpha, some)):
                found = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.ends[found])
                if len(last) == len(some):
                    ids.append(found)
                    lengths.append(np.diff(last, prepend=-1))
                    continue
            if any("<|" in r for r in some):
                found = [np.array(self.tokenizer.encode(r, add_special_tokens=False).ids, np.uint32) for r in some]
                ids += found
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                continue
            found = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(found == self.mark_id)
            lengths.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
            ids.append(found[found != self.mark_id])
        return np.concatenate(ids), np.concatenate(lengths)

    def _lookup(self, runs: list[bytes]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, runs), np.int64, len(runs))
        lengths = self.lengths[codes]
        shift = self.begins[codes] - (np.cumsum(lengths) - lengths)
        return self.ids[np.repeat(shift, lengths) + np.arange(lengths.sum())]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a null text is empty."""
        group: list[list[bytes]] = []
        held = 0
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            # The tokenizer itself parts a word from the signs after it, so a space there changes nothing.
            if b"<|" not in data:
                # Some letters have a composed form with a mark in lower case only, so marks forbid it.
                if self.lowers and b"\xcc" not in data and b"\xcd" not in data:
                    data = data.lower()
                data = SIGNS.sub(rb" \1", data)
            group.append(data.split())
            held += len(data)
            if held >= AT_ONCE:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[bytes]]) -> Iterator[np.ndarray]:
        self._learn([r for runs in group for r in runs])
        for runs in group:
            yield self._lookup(runs)


def _held_encoder(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker, which Spark keeps for its next task, with what it remembers."""
    import tokenizers

    held = vars(tokenizers).setdefault("_attrition_encoders", {})  # this module itself travels by value, anew for each task
    key = hash(tokenizer_json)
    if key not in held:
        held.clear()
        held[key] = Encoder(tokenizer_json)
    return held[key]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST) -> DataFrame:
    """One row per piece of each row of ``docs(doc_id, text, ...)``.

    ``tokenizer`` is the file of a tokenizer.  Returns doc_id, ``start`` (the
    document's ids before the piece), ``length``, ``ids`` (the token ids, the
    document's last one being ``END_ID``), ``doc_tokens``, ``sequence_id``
    (one per piece, unique) and ``offset`` (0: a piece starts its sequence).
    A null or blank text is the end id alone.  Rows that repeat are packed each.
    Further columns are ignored.  An empty table gives an empty result.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _held_encoder(definition.value)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "doc_tokens": []}
            held: list[np.ndarray] = []
            size = 0
            for doc_id, ids in zip(doc_ids, encoder.encode(batch.column("text").to_pylist()), strict=True):
                lengths = piece_lengths(len(ids) + 1, longest)
                out["doc_id"] += [doc_id] * len(lengths)
                out["start"] += (np.cumsum(lengths) - lengths).tolist()
                out["length"] += lengths
                out["doc_tokens"] += [len(ids) + 1] * len(lengths)
                held += [ids, np.array([END_ID], np.uint32)]
                size += len(ids) + 1
                if size >= 1 << 22:
                    yield _pieces(out, held, batch.schema.field("doc_id").type)
                    out, held, size = {c: [] for c in out}, [], 0
            if held:
                yield _pieces(out, held, batch.schema.field("doc_id").type)

    schema = plus(docs.select("doc_id").schema, start="long", length="long", doc_tokens="long", ids="binary")
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return rows.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def _pieces(out: dict[str, list], held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
    data = np.concatenate(held).astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(out["length"])]) * 4
    ids = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    longs = [pa.array(out[c], pa.int64()) for c in ("start", "length", "doc_tokens")]
    columns = [pa.array(out["doc_id"], id_type), *longs, pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])


def digests(pieces: DataFrame) -> DataFrame:
    """The columns of ``pack`` with the ids' CRC-32 in their place."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the pieces to ``path``, a folder for each length."""
    pieces.write.partitionBy("length").parquet(path)


def decoded(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
