"""Fill-in-middle texts: a text's middle is moved behind its suffix, and moved back exactly.

A text is a bytearray of UTF-8. Its prefix, middle and suffix are found by scanning to two cuts, the
sentinels are inserted at the cuts, and segments are exchanged in place: two neighbouring blocks change
places by reversing each of them and then both together. The same three reversals with the block sizes
exchanged undo it, so that restoring finds the sentinels, rotates back and takes them out.

Cuts, form and order of a document come from the SHA-256 of ``<seed>:<id>`` alone, so that they do not
depend on partitions or on other rows. A null text counts as empty. An empty text, one that holds a
sentinel, and a share of all texts stay plain; what a plain text holds is never read as a sentinel.
A null id counts as an empty string. Repeated rows come out equal, an empty table gives no rows, texts
of any length are cut whole. Other columns are kept; those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN, PSM, SPM = "plain", "psm", "spm"
# Bytes of text put out together.
TOGETHER = 1 << 22
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_HASH = "_fim_hash"


@dataclass(frozen=True)
class Plan:
    """Sentinels, the seed of the draws, and the shares (in percent) of moved texts and of ``spm`` among them."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    moved: int = 90
    spm: int = 20


def rotate(held: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the blocks ``begin:middle`` and ``middle:end`` in place."""
    view = memoryview(held)
    for b, e in ((begin, middle), (middle, end), (begin, end)):
        view[b:e] = bytes(view[b:e])[::-1]
    view.release()


def scan(text: bytes, start: int, count: int) -> int:
    """Where the code point ``count`` places after the one at ``start`` begins."""
    if text.isascii():
        return start + count
    return start + len(text[start:].decode("utf-8", "surrogatepass")[:count].encode("utf-8", "surrogatepass"))


def draws(digest: str) -> list[int]:
    """Four numbers from the first four groups of eight digits."""
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, digest: str, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """Length, form, characters of prefix and middle, and the output in UTF-8."""
    n, held = len(text), bytearray(text.encode("utf-8", "surrogatepass"))
    one, two, three, four = draws(digest)
    marks = (plan.prefix, plan.middle, plan.suffix)
    if not n or three % 100 >= plan.moved or any(mark in text for mark in marks):
        return n, PLAIN, None, None, bytes(held)
    first, second = sorted((one % (n + 1), two % (n + 1)))
    cut = scan(held, 0, first)
    stop = scan(held, cut, second - first)
    # From the back, so that the cuts before an insertion stay where they are.
    p, m, s = (mark.encode() for mark in marks)
    held[stop:stop] = s
    held[cut:cut] = m
    held[:0] = p
    front, back = len(p) + cut, len(p) + stop + len(m)
    rotate(held, front, back, len(held))
    form = SPM if four % 100 < plan.spm else PSM
    if form == SPM:
        # Now prefix, suffix, middle; the first two change places.
        rotate(held, 0, front, len(held) - (back - front))
    return n, form, first, second - first, bytes(held)


def restore(output: bytes, form: str | None, plan: Plan) -> bytes:
    """The text of an output, by the inverse rotations."""
    if form not in (PSM, SPM):
        return output
    held = bytearray(output)
    p, m, s = plan.prefix.encode(), plan.middle.encode(), plan.suffix.encode()
    back = held.find(m)
    if form == SPM:
        front = back - held.find(p)  # so long is the prefix with its mark
        rotate(held, 0, back - front, back)
    else:
        front = held.find(s)
    rotate(held, front, back, len(held))
    # Prefix, middle, suffix again; the marks go, the last one first.
    middle = len(held) - back
    for at, mark in ((front + middle, s), (front, m), (0, p)):
        if held[at : at + len(mark)] != mark:
            raise ValueError(f"no {mark.decode()} where a text of form {form} has it")
        del held[at : at + len(mark)]
    return bytes(held)


def _moved(batch: pa.RecordBatch, text: str, plan: Plan) -> Iterator[pa.RecordBatch]:
    kept = batch.drop_columns([text, _HASH])
    rows, size, begin = [], 0, 0
    texts, digests = batch.column(text), batch.column(_HASH)
    for i in range(len(batch)):
        rows.append(transform(texts[i].as_py() or "", digests[i].as_py(), plan))
        size += len(rows[-1][-1])
        if size >= TOGETHER or i == len(batch) - 1:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            part = kept.slice(begin, len(rows))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *_ADDED])
            begin, rows, size = i + 1, [], 0


def _restored(batch: pa.RecordBatch, output: str, form: str, name: str, plan: Plan) -> Iterator[pa.RecordBatch]:
    outputs, forms = batch.column(output), batch.column(form)
    found, size, begin = [], 0, 0
    for i in range(len(batch)):
        found.append(restore(outputs[i].as_py() or b"", forms[i].as_py(), plan))
        size += len(found[-1])
        if size >= TOGETHER or i == len(batch) - 1:
            part = batch.slice(begin, len(found))
            yield part.append_column(name, pa.array(found, pa.binary()))
            begin, found, size = i + 1, [], 0


def _prepared(documents: DataFrame, id: str, text: str, plan: Plan) -> tuple[DataFrame, T.StructType]:
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = documents.drop(*(set(_ADDED) - {id, text})).withColumn(_HASH, digest)
    kept = [f for f in rows.schema.fields if f.name not in (text, _HASH)]
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType())
    return rows, T.StructType([*kept, *(T.StructField(a, k) for a, k in zip(_ADDED, kinds, strict=True))])


def fill_in_middle(documents: DataFrame, id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """Replace ``text`` by ``n`` (its code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` (UTF-8)."""
    rows, schema = _prepared(documents, id, text, plan)
    return rows.mapInArrow(lambda batches: (part for b in batches for part in _moved(b, text, plan)), schema)


def restored(moved: DataFrame, output: str = "output", form: str = "form", name: str = "restored", plan: Plan = Plan()) -> DataFrame:
    """Add column ``name``: the text in UTF-8, exactly as it was."""
    rows = moved.drop(name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
    return rows.mapInArrow(lambda batches: (part for b in batches for part in _restored(b, output, form, name, plan)), schema)


def round_trip(documents: DataFrame, id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``fill_in_middle`` and then ``restored``, by the same Python workers."""
    rows, schema = _prepared(documents.drop(*({"restored"} - {id, text})), id, text, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _moved(batch, text, plan):
                yield from _restored(part, "output", "form", "restored", plan)

    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("restored", T.BinaryType())]))


def digest(column: str) -> Column:
    return F.sha2(F.col(column), 256)
