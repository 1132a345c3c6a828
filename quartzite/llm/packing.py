"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs what its own partition holds, so nothing is shuffled. Whole bins are cut from a long example at once;
what is left of each example goes into a bounded pool. A bin is filled by the dot-product heuristic: of the pooled
examples that fit, it takes the one whose demand vector (tokens, segments, loss tokens, each as a share of its limit)
has the largest dot product with what the bin still has room for. When none fits whole, the best one is cut. A bin that
can't be filled ends at a power of two, so a sequence is never padded.

Ids are those of the tokenizers library. A faster encoder stands in for it where it is proven to give the same ids: when the
vocabulary file splits and merges as byte-level vocabularies do and each of its merges is what merging by rank does with the
same bytes (`merges_by_rank`), and for texts without very long runs of blanks or of other characters, which it can't take.

Defined results: a null or empty text is one end token; an example without ids has no piece; a null id stays null; ids of any
type are carried as they are; equal rows are packed each on its own; an empty table gives no pieces; other columns are not
read; limits under 1 are an error. Sequence ids are unique across partitions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, text_slices

SEQUENCE = 2048
MAX_SEGMENTS = 64
POOL = 1024
END = 1
#: Characters of a run of blanks, or between blanks, from which on a text is left to the tokenizers library.
LONG_RUN = 4096
PIECES = "start long, length long, ids array<int>, loss long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_by_rank(spec: dict) -> dict[bytes, int] | None:
    """Each token's bytes and rank, if lowest-rank merging of neighbours does what the file's list of merges does; else None.

    It does when the k-th merge makes the token of the k-th rank, and merging that token's bytes by lower ranks leaves just the
    two parts that the list names. Then, wherever a token comes about in a text, no other pair could have made it.
    """
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    split = spec.get("pre_tokenizer") or {}
    usual = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not usual or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    for k, (x, y) in enumerate(merges):
        x, y = (bytes(alphabet[c] for c in part) for part in (x, y))
        rank = ranks.get(x + y)
        if rank != 256 + k:
            return None
        parts = [bytes([b]) for b in x + y]
        while len(parts) > 2:
            low, at = min((ranks.get(p + q, rank), i) for i, (p, q) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            if low >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [x, y]:
            return None
    return ranks


def has_long_run(text: str) -> bool:
    if len(text) < LONG_RUN:
        return False
    words = text.split()
    if max(map(len, words), default=0) >= LONG_RUN:
        return True
    return len(text) - sum(map(len, words)) - len(words) >= LONG_RUN - 2 and re.search(rf"\s{{{LONG_RUN}}}", text) is not None


def load_encoder(path: str, ranks: dict[bytes, int] | None = None) -> Callable[[str], list[int]]:
    """An encoder of a vocabulary file of the tokenizers library. ranks: what merges_by_rank gives for the file."""
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(path)

    def by_library(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return by_library
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    marks = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(m in text for m in marks) or has_long_run(text):
            return by_library(text)
        return coder.encode_ordinary(text)

    return encode


class Packer:
    """Packs examples (doc, ids, loss mask or None: every token bears loss) of one partition; gives pieces."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, pool: int):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits must be at least 1")
        self.limit = np.array([tokens, segments, loss], dtype=float)
        self.pool_size, self.next_id = pool, first_id
        self.slots: list = [None] * (2 * pool + 1)  # (doc id, start, total tokens, ids, mask)
        self.free = list(range(len(self.slots)))
        self.need = np.full((len(self.slots), 3), np.inf)
        self.share = np.zeros((len(self.slots), 3))

    def __len__(self) -> int:
        return len(self.slots) - len(self.free)

    @staticmethod
    def loss_of(ids: np.ndarray, mask: np.ndarray | None) -> int:
        return len(ids) if mask is None else int(mask.sum())

    def add(self, doc, ids: np.ndarray, mask: np.ndarray | None = None) -> Iterator[tuple]:
        """mask: 1 for tokens that bear loss."""
        tokens, loss = int(self.limit[0]), int(self.limit[2])
        start, total = 0, len(ids)
        part = lambda a, b: None if mask is None else mask[a:b]
        while total - start >= tokens and (bears := self.loss_of(ids[start : start + tokens], part(start, start + tokens))) <= loss:
            yield doc, start, tokens, ids[start : start + tokens], bears, total, self.next_id, 0
            self.next_id, start = self.next_id + 1, start + tokens
        if start < total:
            self.keep(doc, start, total, ids[start:], part(start, total))
        if len(self) >= 2 * self.pool_size:
            yield from self.fill(self.pool_size)

    def keep(self, doc, start: int, total: int, ids: np.ndarray, mask: np.ndarray | None, slot: int | None = None) -> None:
        slot = self.free.pop() if slot is None else slot
        self.slots[slot] = (doc, start, total, ids, mask)
        self.need[slot] = len(ids), 1, self.loss_of(ids, mask)
        self.share[slot] = self.need[slot] / self.limit

    def drop(self, slot: int) -> None:
        self.slots[slot], self.need[slot], self.share[slot] = None, np.inf, 0
        self.free.append(slot)

    def fill(self, until: int = 0) -> Iterator[tuple]:
        """Close bins until at most `until` examples are pooled."""
        while len(self) > until:
            room, taken, free = self.limit.copy(), [], np.isfinite(self.need[:, 0])
            while True:
                score = self.share @ (room / self.limit)
                score[~free | (self.need > room).any(axis=1)] = -1
                i = int(score.argmax())
                if score[i] < 0:
                    break
                taken.append((i, len(self.slots[i][3])))
                room -= self.need[i]
                free[i] = False
            if room[0] and room[1] >= 1 and free.any():  # none fits whole: cut the one with the most tokens
                i = int(np.where(free, self.need[:, 0], -1).argmax())
                ids, mask = self.slots[i][3:]
                n = int(min(room[0], len(ids)))
                if self.loss_of(ids[:n], None if mask is None else mask[:n]) > room[2]:
                    n = int(room[2]) if mask is None else int(np.searchsorted(np.cumsum(mask), room[2], "right"))
                if n:
                    taken.append((i, n))
            yield from self.close(taken)

    def close(self, taken: list[tuple[int, int]]) -> Iterator[tuple]:
        """Emit a bin of the parts, cut to the largest power of two where it isn't full; the rest of the cut example stays pooled."""
        total = sum(n for _, n in taken)
        size = total if total == int(self.limit[0]) else 1 << (total.bit_length() - 1)
        at = 0
        for i, n in taken:
            n = min(n, size - at)
            doc, start, whole, ids, mask = self.slots[i]
            if n:
                yield doc, start, n, ids[:n], self.loss_of(ids[:n], None if mask is None else mask[:n]), whole, self.next_id, at
                if n < len(ids):
                    self.keep(doc, start + n, whole, ids[n:], None if mask is None else mask[n:], i)
                else:
                    self.drop(i)
            at += n
        self.next_id += 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = SEQUENCE, segments: int = MAX_SEGMENTS, loss: int | None = None, pool: int = POOL, end: int = END, crc32: bool = False) -> DataFrame:
    """Pack whole texts, each followed by the end token; every token of a text bears loss.

    With crc32, each piece carries instead of its ids their CRC-32 as little-endian unsigned 32-bit numbers (ids_crc32).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    limit = tokens if loss is None else loss
    with open(tokenizer, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(merges_by_rank(json.load(file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer, held.value)
        packer = Packer(TaskContext.get().partitionId() << 36, tokens, segments, limit, pool)
        for part in text_slices(batches, limit=1 << 20):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                out += packer.add(doc, np.array([*encode(text or ""), end], np.int32))
            yield from pieces(out, kind, crc32)
        yield from pieces(list(packer.fill()), kind, crc32)

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind, schema = _schema(rows)
    return rows.mapInArrow(run, schema.replace("ids array<int>", "ids_crc32 long") if crc32 else schema)


def _schema(rows: DataFrame) -> tuple[pa.DataType, str]:
    """The Arrow type of the ids, and the schema of pieces that carry them."""
    own = rows.schema["doc_id"].dataType
    return to_arrow_type(own), f"doc_id {own.simpleString()}, {PIECES}"


def pack_examples(examples: DataFrame, tokens: int = SEQUENCE, segments: int = MAX_SEGMENTS, loss: int = SEQUENCE, pool: int = POOL) -> DataFrame:
    """Pack instruction data that is already tokenised: doc_id, ids array<int>, loss_mask array<int> (null: every token bears loss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, tokens, segments, loss, pool)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += packer.add(row["doc_id"], np.array(row["ids"] or [], np.int32), None if row["loss_mask"] is None else np.array(row["loss_mask"], np.int8))
            yield from pieces(out, kind)
        yield from pieces(list(packer.fill()), kind)

    kind, schema = _schema(examples)
    return examples.select("doc_id", "ids", "loss_mask").mapInArrow(run, schema)


def pieces(rows: list[tuple], kind: pa.DataType, crc32: bool = False) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        doc, start, length, ids, loss, total, sequence, offset = zip(*rows[at : at + 4096], strict=True)
        if crc32:
            tokens = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        else:
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate(ids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()), tokens, *(pa.array(x, pa.int64()) for x in (loss, total, sequence, offset))],
            names=["doc_id", "start", "length", "ids_crc32" if crc32 else "ids", "loss", "doc_tokens", "sequence_id", "offset"],
        )
